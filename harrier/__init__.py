"""Harrier: security-event analytics and text-corpus operators as Spark DataFrame jobs."""
