"""Access rules against targets by an index of literal prefixes.

A rule can only fit a target that begins with what the rule says before its first star. That literal is cut to the longest of some fixed lengths and becomes
the rule's key; a target has one key for each of these lengths, about twenty at most. Rules and targets meet by an
equi-join on (site, key), so no site's rules meet all its targets, however many rules it has; what is met is then verified whole. The longest fitting rule is the
maximum of an aggregate that is combined before its shuffle.

Defined results: null sites, rules and targets take no part, so a target without them is allowed by no rule; empty rules say nothing; repeated rules count once; of equally long rules an allowing one decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import signals
from webloom.functions.dialect import SPARK as S

#: Key lengths: each about half as long again as the one before.
LENGTHS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
_LENGTHS = f"array({', '.join(map(str, LENGTHS))})"


def keyed_rules(rules: DataFrame) -> DataFrame:
    """(site, prefix, kind, rule) of rules (site, kind, rule), each once."""
    literal = f"regexp_replace(regexp_extract(rule, {S.lit(r'(?s)^([^*]*)')}, 1), {S.lit(r'\$\z')}, CASE WHEN contains(rule, '*') THEN {S.lit('\\$')} ELSE '' END)"
    cut = f"substr(literal, 1, array_max(filter({_LENGTHS}, n -> n <= length(literal))))"
    once = rules.select("site", "kind", "rule").where("site IS NOT NULL AND rule IS NOT NULL AND rule <> ''").distinct()
    return once.selectExpr("*", f"{literal} AS literal").selectExpr("site", f"{cut} AS prefix", "kind", "rule")


def keyed_targets(targets: DataFrame) -> DataFrame:
    """(id, site, target, prefix) of targets (id, site, target): a row for each key that one of its rules may have."""
    wanted = targets.select("id", "site", "target").where("site IS NOT NULL AND target IS NOT NULL")
    return wanted.selectExpr("id", "site", "target", f"explode(transform(filter({_LENGTHS}, n -> n <= length(target)), n -> substr(target, 1, n))) AS prefix")


def fitting(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, kind, rule) for every rule that fits a target."""
    met = keyed_targets(targets).join(keyed_rules(rules), ["site", "prefix"])
    return met.where(signals.rule_fits(S, "rule", "target")).select("id", "kind", "rule")


def decide(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, site, rule, kind, allowed) of every target: the longest rule that fits and its kind, null for none; a target is allowed unless that one disallows it, and /robots.txt always."""
    order = F.struct(F.length("rule"), F.col("kind") == "allow", "rule")
    best = fitting(targets, rules).groupBy("id").agg(F.max_by(F.struct("kind", "rule"), order).alias("b"))
    out = targets.select("id", "site", "target").join(best, "id", "left")
    allowed = F.coalesce(F.col("b.kind") != "disallow", F.lit(True)) | F.coalesce(F.col("target") == "/robots.txt", F.lit(False))
    return out.select("id", "site", F.col("b.rule").alias("rule"), F.col("b.kind").alias("kind"), allowed.alias("allowed"))
