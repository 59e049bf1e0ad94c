"""Addresses and long lists of networks: an equi-join by prefixes, for lists that no expression could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions.fields import ip_hex, network_key, normalize_ip


def _parsed(text: Column) -> Column:
    """array(struct(bits, key)) of a network, empty if it is none. All inside functions over arrays, so that no filter above repeats it."""
    address, cut = F.substring_index(text, "/", 1), text.contains("/")
    given = F.regexp_extract(text, r"/(\d{1,3})$", 1).try_cast("int")

    def of(h: Column) -> Column:
        most = F.length(h) * 4
        # IPv4 networks may be written as mapped IPv6 ones
        bits = F.when(~cut, most).when(address.contains(":") & (most == 32), given - 96).otherwise(given)
        return F.struct(F.when(bits.between(0, most), bits).alias("bits"), h.alias("hex"))

    found = F.filter(F.transform(F.transform(F.array(normalize_ip(address)), ip_hex), of), lambda s: s["bits"].isNotNull())
    return F.coalesce(F.transform(found, lambda s: F.struct(s["bits"].alias("bits"), network_key(s["hex"], s["bits"]).alias("key"))), F.array())


def parse_networks(rows: DataFrame, column: str = "network") -> DataFrame:
    """The rows that name a network, with `net_key` and `net_bits`; an address without /bits is a network of its own, host bits are ignored.

    What is no network (no address, too many bits, null) is left out.
    """
    return rows.withColumn("__n", F.explode(_parsed(F.trim(F.col(column))))).withColumns({"net_bits": F.col("__n.bits"), "net_key": F.col("__n.key")}).drop("__n")


def address_networks(addresses: DataFrame, networks: DataFrame, ip: str = "ip", column: str = "network") -> DataFrame:
    """Rows (ip, network, bits): each distinct address (canonical, as normalised events hold it) with every network of the list that holds it, the longest as well as those around it.

    An address looks itself up once for each length of prefix that the list has (161 at most, whatever the list), so the
    join is on equal keys and no address meets a network it is not in. Repeated networks count once.
    """
    nets = parse_networks(networks, column).select(F.col(column).alias("network"), "net_key", "net_bits").dropDuplicates(["net_key"])
    lengths = nets.select(F.substring_index("net_key", "/", 1).cast("int").alias("digits"), "net_bits").select("digits", "net_bits").distinct().collect()  # 161 rows at most
    of = {d: sorted(r["net_bits"] for r in lengths if r["digits"] == d) for d in (8, 32)}
    some = lambda d: F.lit(of[d]).cast("array<int>") if of[d] else F.array().cast("array<int>")
    found = addresses.select(F.col(ip).alias("ip")).where("ip IS NOT NULL").distinct().withColumn("__hex", F.transform(F.array("ip"), ip_hex)[0])
    found = found.withColumn("__bits", F.explode(F.when(F.col("__hex").isNull(), F.array().cast("array<int>")).when(F.length("__hex") == 8, some(8)).otherwise(some(32)))).withColumn("net_key", network_key(F.col("__hex"), F.col("__bits")))
    return found.join(nets, "net_key").select("ip", "network", F.col("net_bits").alias("bits"))


def narrowest_network(addresses: DataFrame, networks: DataFrame, ip: str = "ip", column: str = "network") -> DataFrame:
    """Rows (ip, network, bits): each address that any network holds, with the one of most bits."""
    return address_networks(addresses, networks, ip, column).groupBy("ip").agg(F.max_by("network", "bits").alias("network"), F.max("bits").alias("bits"))


def within(events: DataFrame, networks: DataFrame, ip: str = "ip", column: str = "network") -> DataFrame:
    """Events whose address is in a network of the list."""
    inside = address_networks(events, networks, ip, column).select(F.col("ip").alias("__ip")).distinct()
    return events.join(inside, F.col(ip) == F.col("__ip"), "left_semi")


def outside(events: DataFrame, networks: DataFrame, ip: str = "ip", column: str = "network", when: Column | None = None) -> DataFrame:
    """Events whose address is in no network of an allow-list, or that do not meet `when` (null: do not); without an address they stay."""
    inside = address_networks(events if when is None else events.where(when), networks, ip, column).select(F.col("ip").alias("__ip")).distinct()
    same = F.col(ip) == F.col("__ip")
    return events.join(inside, same if when is None else same & F.coalesce(when, F.lit(False)), "left_anti")
