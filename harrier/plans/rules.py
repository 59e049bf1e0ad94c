"""Detection rules as data: loading, validation, and compilation to column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field as default
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions.fields import FIELDS, decoded_variants, field, in_cidr, ip_hex, micros
from harrier.schema import SEVERITIES

KINDS: dict[str, Callable[[Rule], Callable[[DataFrame], DataFrame]] | None] = {"signature": None, "threshold": None, "beacon": None, "correlation": None}
_IPS = {"ip", "dst_ip"}


@dataclass
class Rule:
    name: str
    kind: str
    severity: str
    description: str = ""
    alert_type: str | None = None
    reason: str | None = None
    disabled: bool = False
    cooldown: str | None = None
    when: dict = default(default_factory=dict)
    fields: list[str] = default(default_factory=list)
    contains: list[str] = default(default_factory=list)
    regex: list[str] = default(default_factory=list)
    paths: list[str] = default(default_factory=list)
    threshold: int | None = None
    window: str | None = None
    distinct: str | None = None
    group_by: str | None = None
    min_interval: str | None = None
    max_jitter: float | None = None

    def check(self) -> None:
        fail = lambda text: (_ for _ in ()).throw(ValueError(f"rule {self.name!r}: {text}"))
        if not self.name or self.kind not in KINDS:
            fail(f"unknown kind {self.kind!r}")
        if self.severity not in SEVERITIES:
            fail(f"unknown severity {self.severity!r}")
        if extra := set(self.when) - {"event_types", "status_codes", "match", "except"}:
            fail(f"unknown conditions {sorted(extra)}")
        if self.cooldown is not None:
            micros(self.cooldown)
        named = [*self.fields, *filter(None, (self.distinct, self.group_by)), *self.when.get("match", {}), *(f for s in self.when.get("except", []) for f in s)]
        for f in named:
            if f not in FIELDS and not (f.startswith("metadata.") and len(f) > 9):
                fail(f"unknown field {f!r}")
        if any(not s for s in self.when.get("except", [])):
            fail("an empty exception excepts everything")
        if self.kind == "signature" and not (self.fields and (self.contains or self.regex or self.paths)):
            fail("a signature needs fields and patterns")
        if self.kind in ("threshold", "beacon", "correlation") and (not self.threshold or self.threshold < 1 or not self.window or micros(self.window) <= 0):
            fail("a positive threshold and window are needed")
        if self.kind == "beacon" and (self.threshold < 3 or not self.min_interval or not self.max_jitter or self.max_jitter <= 0 or not self.group_by):
            fail("a beacon needs group_by, three contacts or more, min_interval and max_jitter")
        if self.kind == "correlation" and self.threshold < 2:
            fail("a correlation needs two rules or more")


@dataclass
class RuleSet:
    rules: list[Rule]
    default_cooldown: str = "1m"

    def __post_init__(self):
        names = [r.name for r in self.rules]
        if len(set(names)) < len(names):
            raise ValueError("rule names must be unique")
        for r in self.rules:
            r.check()

    @property
    def active(self) -> list[Rule]:
        return [r for r in self.rules if not r.disabled]

    def cooldown(self, rule: Rule) -> int:
        return micros(rule.cooldown if rule.cooldown is not None else self.default_cooldown)

    def order(self) -> list[Rule]:
        """As ties are broken: rules in file order, correlations after them."""
        return sorted(self.active, key=lambda r: r.kind == "correlation")

    def lookback(self) -> int:
        """Microseconds of alert history that cooldowns and correlations look back on."""
        return max([0, *map(self.cooldown, self.active), *(micros(r.window) for r in self.active if r.kind == "correlation")])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.name, r.kind, r.severity, r.alert_type, r.disabled, self.cooldown(r)) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "ord int, name string, kind string, severity string, alert_type string, disabled boolean, cooldown_us long")


def register_rule_kind(name: str, factory: Callable[[Rule], Callable[[DataFrame], DataFrame]]) -> None:
    """A further kind of rule: the factory turns a rule into a function from events to firings (see operators.detect)."""
    KINDS[name] = factory


def load_rules(source: str | dict) -> RuleSet:
    """Rules from JSON or the like; unknown, mis-cased and repeated keys are errors."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise ValueError(f"repeated key in {keys}")
        return dict(pairs)

    data = json.loads(source, object_pairs_hook=once) if isinstance(source, str) else source
    if extra := set(data) - {"rules", "default_cooldown"}:
        raise ValueError(f"unknown keys {sorted(extra)}")
    known = Rule.__dataclass_fields__
    for r in data["rules"]:
        if extra := set(r) - set(known):
            raise ValueError(f"unknown keys {sorted(extra)} in rule {r.get('name')!r}")
    return RuleSet([Rule(**r) for r in data["rules"]], data.get("default_cooldown", "1m"))


def _equals(name: str, values: list[str]) -> Column:
    value = F.coalesce(F.lower(field(name)), F.lit(""))
    plain = [v.lower() for v in values if not (name in _IPS and "/" in v)]
    nets = [in_cidr(ip_hex(F.col(name)), v) for v in values if name in _IPS and "/" in v]
    out = value.isin(plain) if plain else F.lit(False)
    for n in nets:
        out = out | n
    return F.coalesce(out, F.lit(False))


def _all_of(conditions: dict[str, list[str]]) -> Column:
    out = F.lit(True)
    for name, values in conditions.items():
        out = out & _equals(name, values)
    return out


def compile_filter(when: dict) -> Column:
    """Whether an event meets a rule's conditions; never null."""
    out = F.lit(True)
    if types := when.get("event_types"):
        out = out & F.coalesce(F.col("event_type").isin(types), F.lit(False))
    if codes := when.get("status_codes"):
        out = out & F.coalesce(F.col("status_code").isin(codes), F.lit(False))
    if match := when.get("match"):
        out = out & _all_of(match)
    for excepted in when.get("except", []):
        out = out & ~_all_of(excepted)
    return out


def java_regex(pattern: str) -> str:
    """A linear-time engine's pattern for Java: $ is the very end, only line feed is no dot, blanks lack the vertical tab."""
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            out += {"\\s": r"\t\n\f\r " if inside else r"[\t\n\f\r ]", "\\S": r"[^\t\n\f\r ]"}.get(pair, pair) if pair != "\\S" or not inside else pair
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside and not out.endswith("["):
            inside = False
        out += r"\z" if c == "$" and not inside else c
        i += 1
    return f"(?diu){out}"


def matches_signature(rule: Rule, variants: Callable[[str], Column] | None = None) -> Column:
    """struct(pattern, field) of the first match, null without one: fields in order, variants in order, then contains, paths, regex.

    variants: the decoded variants of a field, where they have been computed before for several rules.
    """
    # the patterns are tried inside a function over the variants, which are computed once and keep the generated code small
    variants = variants or (lambda name: decoded_variants(field(name)))
    original = {p.lower(): p for p in reversed([*rule.contains, *rule.paths]) if p != p.lower()}

    def listed(patterns: list[str], test: Callable[[Column], Column]) -> Column:
        """The first of these texts that passes; the list is one folded constant."""
        hit = F.get(F.filter(F.split(F.lit("\0".join(p.lower() for p in patterns)), "\0"), test), F.lit(0))
        return reduce(lambda c, p: F.when(hit == p, F.lit(original[p])).otherwise(c), [p for p in original if p in map(str.lower, patterns)], hit)

    def first(v: Column) -> Column:
        tests = []
        if rule.contains:
            tests.append(listed(rule.contains, lambda p: v.contains(p)))
        if rule.paths:  # a regular expression only where the text is there at all
            tests.append(listed(rule.paths, lambda p: v.contains(p) & F.rlike(v, F.concat(F.lit("\\Q"), p, F.lit("\\E([/?#.;]|\\z)")))))
        single = [F.when(v.rlike(java_regex(p)), F.lit(p)) for p in rule.regex]
        if len(single) > 1:  # all in one first, since most texts meet none
            tests.append(F.when(v.rlike("|".join(f"(?:{java_regex(p)})" for p in rule.regex)), F.coalesce(*single)))
        else:
            tests += single
        return F.coalesce(*tests)

    def of(name: str) -> Column:
        hit = F.get(F.array_compact(F.transform(variants(name), first)), F.lit(0))
        return F.transform(F.array(hit), lambda p: F.when(p.isNotNull(), F.struct(p.alias("pattern"), F.lit(name).alias("field"))))[0]

    return F.coalesce(*map(of, rule.fields))


def with_signatures(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each event and signature it meets, with `sig` (rule, pattern, field): one pass, each field decoded once."""
    names = sorted({f for r in rules for f in r.fields})
    rows = events.withColumns({f"__v{i}": decoded_variants(field(n)) for i, n in enumerate(names)})
    variants = lambda n: F.col(f"__v{names.index(n)}")

    def named(rule: Rule) -> Column:
        hit = F.when(compile_filter(rule.when), matches_signature(rule, variants))
        return F.transform(F.array(hit), lambda h: F.when(h.isNotNull(), F.struct(F.lit(rule.name).alias("rule"), h["pattern"].alias("pattern"), h["field"].alias("field"))))[0]

    return rows.withColumn("sig", F.explode(F.array_compact(F.array(*map(named, rules))))).drop(*[f"__v{i}" for i in range(len(names))])
