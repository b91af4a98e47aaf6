"""Routing of events to targets by rules. In routing, unlike in search, a missing value never matches,
negated or not."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..paths import any_at, col_at, has_path, leaves
from ..rules import FilterRule, RoutingRule
from .filters import predicate

#: Rule conditions that are broadcast at the most; more of them are joined by a shuffle.
MAX_BROADCAST_CONDITIONS = 100_000
#: Sets of paths that rules are looked up by; with more of them, conditions are counted.
MAX_PATH_SETS = 200


def routing_predicate(df: DataFrame, rule: FilterRule) -> Column:
    if not has_path(df, rule.path):
        return F.lit(False)
    held = predicate(df, replace(rule, negate=False))
    if rule.op == "=" and rule.value is None:
        return F.lit(False) if not rule.negate else any_at(df, rule.path, lambda c, _: c.isNotNull())
    if not rule.negate:
        return F.coalesce(held, F.lit(False))
    present = any_at(df, rule.path, lambda c, _: c.isNotNull())
    return F.coalesce(present, F.lit(False)) & ~F.coalesce(held, F.lit(False))


def matches(df: DataFrame, filters: Iterable[FilterRule]) -> Column:
    """Whether all filters match; none match nothing."""
    tests = [routing_predicate(df, f) for f in filters]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


def match_rules(df: DataFrame, rules: Iterable[RoutingRule], out: str = "rule_ids") -> DataFrame:
    """df with the ids of the rules that match each event."""
    ids = [F.when(matches(df, r.filters), F.lit(r.rule_id).cast("long")) for r in rules]
    return df.withColumn(out, F.array_compact(F.array(*ids)) if ids else F.array().cast("array<long>"))


def conditions(spark, rules: Iterable[RoutingRule]) -> DataFrame:
    """Equality rules as rows (rule, rule_id, path, value, needed): `rule` tells apart rules that share an id."""
    rows = []
    for i, r in enumerate(rules):
        if any(f.op != "=" or f.negate or f.value is None for f in r.filters):
            raise ValueError(f"rule {r.rule_id} is not of equalities alone")
        needed = len({(f.path, str(f.value)) for f in r.filters})
        rows += [(i, r.rule_id, p, v, needed) for p, v in dict.fromkeys((f.path, str(f.value)) for f in r.filters)]
    return spark.createDataFrame(rows, "rule long, rule_id long, path string, value string, needed int")


def match_rules_join(df: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, rule_ids) of the events that match a rule, for very many equality rules (see conditions()).

    Rules that name the same paths are looked up together by their values: an event has one row for each
    set of paths, and one for each rule that it matches. Of more than MAX_PATH_SETS sets, single conditions
    are joined instead, and matches are counted.
    """
    whole = rules.groupBy("rule", "rule_id").agg(F.sort_array(F.collect_set(F.struct("path", "value"))).alias("all"))
    whole = whole.select("rule_id", F.col("all.path").alias("paths"), F.col("all.value").alias("values"))
    sets = [list(r[0]) for r in whole.select("paths").distinct().limit(MAX_PATH_SETS + 1).collect()]
    small = rules.limit(MAX_BROADCAST_CONDITIONS + 1).count() <= MAX_BROADCAST_CONDITIONS
    if len(sets) > MAX_PATH_SETS:
        return _counted(df, rules, key, small)
    tried = [F.struct(F.array(*map(F.lit, s)).alias("paths"), F.array(*(col_at(df, p).cast("string") for p in s)).alias("values")) for s in sets if all(has_path(df, p) for p in s)]
    if not tried:
        return df.select(key, F.array().cast("array<long>").alias("rule_ids")).limit(0)
    values = df.select(key, F.explode(F.array(*tried)).alias("x")).select(key, "x.paths", "x.values").filter(~F.exists("values", lambda v: v.isNull()))
    met = values.join(F.broadcast(whole) if small else whole, ["paths", "values"])
    return met.groupBy(key).agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def _counted(df: DataFrame, rules: DataFrame, key: str, small: bool) -> DataFrame:
    """The same from single conditions: each event's values at the paths of its schema are joined to the rules."""
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), col_at(df, p).cast("string").alias("value")) for p, _ in leaves(df.schema)))
    known = rules.filter(F.col("path").isin([p for p, _ in leaves(df.schema)]))
    values = df.select(key, F.explode(pairs).alias("x")).select(key, "x.path", "x.value").filter("value is not null")
    met = values.join(F.broadcast(known) if small else known, ["path", "value"])
    full = met.groupBy(key, "rule", "rule_id", "needed").agg(F.count_distinct("path", "value").alias("n")).filter("n = needed")
    return full.groupBy(key).agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def route(df: DataFrame, rules: Iterable[RoutingRule]) -> DataFrame:
    """A row for each event and matching rule, with via_rule_id and target. Events that came by a rule
    (via_rule_id set) are not routed again."""
    rules = list(rules)
    fresh = df.filter("via_rule_id is null").drop("via_rule_id") if "via_rule_id" in df.columns else df
    names = F.create_map(*(x for r in rules for x in (F.lit(r.rule_id).cast("long"), F.lit(r.target)))) if rules else F.create_map().cast("map<bigint,string>")
    routed = match_rules(fresh, rules, "rule_ids_").withColumn("via_rule_id", F.explode("rule_ids_")).drop("rule_ids_")
    return routed.withColumn("target", names[F.col("via_rule_id")])


def write_routed(df: DataFrame, path: str, mode: str = "append") -> None:
    """Routed events in a folder for each target."""
    df.write.mode(mode).partitionBy("target").parquet(path)


def rule_hits(df: DataFrame, rules: Iterable[RoutingRule]) -> DataFrame:
    """Events of each rule that has any."""
    return route(df, rules).groupBy(F.col("via_rule_id").alias("rule_id")).agg(F.count("*").alias("hits"))
