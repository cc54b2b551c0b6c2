"""Detection and counting with a rule pack; every rule sees the original text."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cfgveil.functions.ambiguity import Ambiguity
from cfgveil.operators.occurrences import counted_literals
from cfgveil.packs import LIBRARY
from cfgveil.rules import (
    Rule,
    RulePack,
    any_of,
    odd_folding,
    recursion_risk,
    rule_ambiguity,
    rule_problems,
)

# How many matches per rule and text a preview shows.
SHOWN = 10


def _prepared(df: DataFrame, content: str) -> DataFrame:
    return df.withColumn("__folded", F.lower(F.col(content))).withColumn("__odd", odd_folding(F.col(content)))


def _guarded(rule: Rule, content: str, value: Column, otherwise: Column) -> Column:
    guard = rule.guard(F.col(content), F.col("__folded"), F.col("__odd"))
    return value if guard is None else F.when(guard, value).otherwise(otherwise)


def _counted(df: DataFrame, rules: Sequence[Rule], content: str, prefix: str = "__n") -> DataFrame:
    """One count column per rule, in a single projection."""
    columns = {
        f"{prefix}_{i}": _guarded(r, content, r.count(F.col(content)), F.lit(0)).cast("bigint")
        for i, r in enumerate(rules)
    }
    return _prepared(df, content).withColumns(columns)


def detect_secrets(
    df: DataFrame,
    key: Sequence[str],
    pack: RulePack = LIBRARY,
    *,
    content: str = "content",
    shown: int | None = None,
    secret_group: bool = False,
) -> DataFrame:
    """Long form of the detections: key, ordinal, rule, position, value.

    The value is the last group of a match (the whole match without groups), of every
    match, or of the first `shown` per rule and text. With `secret_group` it is the group that
    holds the secret where the rule names one.
    """
    entries = []
    for i, rule in enumerate(pack.rules, 1):
        group = rule.detected_group()
        if secret_group and rule.secret_group is not None:
            group = rule.secret_group
        found = F.regexp_extract_all(F.col(content), F.lit(rule.java()), F.lit(group))
        if shown is not None:
            found = F.slice(found, 1, shown)
        none = F.array().cast("array<string>")
        entries.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(rule.name).alias("rule"),
                _guarded(rule, content, found, none).alias("found"),
            )
        )
    listed = _prepared(df, content).select(*key, F.inline(F.array(*entries)))
    return listed.select(
        *key, "ordinal", "rule", F.posexplode("found").alias("position", "value")
    ).withColumn("position", F.col("position") + 1)


def detection_preview(df: DataFrame, key: Sequence[str], pack: RulePack = LIBRARY, *, content: str = "content", shown: int = SHOWN) -> DataFrame:
    """The first `shown` detections per rule and text."""
    return detect_secrets(df, key, pack, content=content, shown=shown)


def detections_map(df: DataFrame, key: Sequence[str], pack: RulePack = LIBRARY, *, content: str = "content", shown: int | None = None) -> DataFrame:
    """Per text, a map from rule name to its detected values, the first `shown` if given (rules without a match left out)."""

    def values(rule: Rule) -> Column:
        every = F.regexp_extract_all(F.col(content), F.lit(rule.java()), F.lit(rule.detected_group()))
        return every if shown is None else F.slice(every, 1, shown)

    found = [_guarded(r, content, values(r), F.array().cast("array<string>")) for r in pack.rules]
    everything = F.map_from_arrays(F.array(*[F.lit(r.name) for r in pack.rules]), F.array(*found))
    return _prepared(df, content).select(
        *key, F.map_filter(everything, lambda _, values: F.size(values) > 0).alias("detections")
    )


def pattern_stats(df: DataFrame, key: Sequence[str], pack: RulePack = LIBRARY, *, content: str = "content") -> DataFrame:
    """key, ordinal, rule, n for every rule that matches a text."""
    counted = _counted(df, pack.rules, content)
    entries = [
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(r.name).alias("rule"), F.col(f"__n_{i}").alias("n"))
        for i, r in enumerate(pack.rules)
    ]
    return counted.select(*key, F.inline(F.array(*entries))).filter("n > 0")


def rule_audit(df: DataFrame, rules: Iterable[Rule], *, content: str = "content") -> DataFrame:
    """For each rule: is it valid, does it risk deep recursion or backtracking, its hits and its files.

    `ambiguity` (none, quadratic, exponential, unknown) tells in how many ways the pattern
    can read one text that doesn't match, and `witness` is such a text. Invalid rules are found before the plan is built and never run. The corpus is
    reduced to one row of sums in a single pass; nothing is exploded per file.
    """
    rules = list(rules)
    spark = df.sparkSession
    problems = rule_problems(spark, rules)
    valid = [r for r in rules if problems[r.name] is None]
    ways = [rule_ambiguity(r) if problems[r.name] is None else Ambiguity("unknown") for r in rules]
    shown = spark.createDataFrame(
        [
            (i, r.name, problems[r.name] is None, problems[r.name], problems[r.name] is None and recursion_risk(r), w.kind, w.witness())
            for i, (r, w) in enumerate(zip(rules, ways, strict=True), 1)
        ],
        "ordinal int, rule string, valid boolean, problem string, recursion_risk boolean, ambiguity string, witness string",
    )
    if not valid:
        return shown.withColumns({"hits": F.lit(0).cast("bigint"), "files": F.lit(0).cast("bigint")})
    sums = [F.sum(f"__n_{i}").alias(f"hits_{i}") for i in range(len(valid))]
    files = [F.count_if(F.col(f"__n_{i}") > 0).alias(f"files_{i}") for i in range(len(valid))]
    totals = _counted(df, valid, content).agg(*sums, *files)
    entries = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.coalesce(F.col(f"hits_{i}"), F.lit(0)).cast("bigint").alias("hits"),
            F.col(f"files_{i}").cast("bigint").alias("files"),
        )
        for i, r in enumerate(valid)
    ]
    hits = totals.select(F.inline(F.array(*entries)))
    return shown.join(hits, "rule", "left").withColumns(
        {"hits": F.coalesce("hits", F.lit(0)), "files": F.coalesce("files", F.lit(0))}
    )


def pack_coverage(df: DataFrame, packs: Mapping[str, RulePack] | Iterable[RulePack], *, content: str = "content") -> DataFrame:
    """Per pack: number of rules, rules that hit, hits and files with a hit, in one pass over the corpus."""
    listed = list(packs.values()) if isinstance(packs, Mapping) else list(packs)
    rules = [(p, r) for p in listed for r in p.rules]
    counted = _counted(df, [r for _, r in rules], content)
    sums = [F.coalesce(F.sum(f"__n_{i}"), F.lit(0)).alias(f"hits_{i}") for i in range(len(rules))]
    files = [
        F.count_if(any_of([F.col(f"__n_{i}") > 0 for i, (p, _) in enumerate(rules) if p is pack])).alias(f"files_{j}")
        for j, pack in enumerate(listed)
    ]
    totals = counted.agg(*sums, *files)
    entries = []
    for j, pack in enumerate(listed):
        mine = [F.col(f"hits_{i}") for i, (p, _) in enumerate(rules) if p is pack]
        entries.append(
            F.struct(
                F.lit(pack.name).alias("pack"),
                F.lit(len(pack.rules)).alias("rules"),
                sum(((h > 0).cast("int") for h in mine), F.lit(0)).alias("rules_hit"),
                sum(mine, F.lit(0).cast("bigint")).alias("hits"),
                F.col(f"files_{j}").cast("bigint").alias("files"),
            )
        )
    return totals.select(F.inline(F.array(*entries)))


def _candidates(df: DataFrame, rules: Sequence[Rule], content: str) -> DataFrame:
    """`__rules`: numbers, in order, of the rules that may match: those one of whose literals the text holds.

    An inverted index from literal to rules is looked up with an automaton's finds, one pass
    for rules that ignore case and one for the others. Rules without a literal, and where
    folding is odd those that ignore case, are always candidates.
    """
    found = [F.array(*[F.lit(k) for k, r in enumerate(rules) if not r.literals]).cast("array<int>")]
    text = F.coalesce(F.col(content), F.lit(""))
    for ignores in (True, False):
        index: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            for literal in rule.literals if rule.ignores_case is ignores else ():
                index.setdefault(literal, []).append(k)
        if index:
            holders = F.from_json(F.lit(json.dumps(list(index.values()))), "array<array<int>>")  # by number of the literal
            held = counted_literals(F.lower(text) if ignores else text, list(index))["literal"]
            df = df.withColumn(f"__held_{ignores}", held)
            found.append(F.flatten(F.transform(f"__held_{ignores}", partial(F.get, holders))))
            if ignores:
                every = F.from_json(F.lit(json.dumps(sorted({k for ks in index.values() for k in ks}))), "array<int>")
                found.append(F.when(odd_folding(text), every).otherwise(F.array().cast("array<int>")))
    return df.withColumn("__rules", F.array_sort(F.array_distinct(F.concat(*found))))


def pattern_stats_indexed(df: DataFrame, key: Sequence[str], rules: Iterable[Rule], *, content: str = "content") -> DataFrame:
    """As `pattern_stats`, for any number of rules: key, ordinal, rule, n.

    The plan doesn't grow with the rules: patterns are an array, and each text evaluates only
    those whose literal it holds.
    """
    rules = list(rules)
    listed = lambda values: F.from_json(F.lit(json.dumps(values)), "array<string>")
    patterns, names = listed([r.java_counted() for r in rules]), listed([r.name for r in rules])
    tried = F.transform(
        "__rules",
        lambda k: F.struct((k + 1).alias("ordinal"), F.get(names, k).alias("rule"), F.regexp_count(F.col(content), F.get(patterns, k)).cast("bigint").alias("n")),
    )
    return _candidates(df, rules, content).where(F.size("__rules") > 0).select(*key, F.inline(tried)).where("n > 0")


def detect_secrets_indexed(df: DataFrame, key: Sequence[str], rules: Iterable[Rule], *, content: str = "content") -> DataFrame:
    """As `detect_secrets` without a limit, for any number of rules: key, ordinal, rule, position, value."""
    rules = list(rules)
    listed = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    patterns, names, groups = listed([r.java() for r in rules], "string"), listed([r.name for r in rules], "string"), listed([r.detected_group() for r in rules], "int")
    tried = F.flatten(
        F.transform(
            "__rules",
            lambda k: F.transform(
                F.regexp_extract_all(F.col(content), F.get(patterns, k), F.get(groups, k)),
                lambda v, i: F.struct((k + 1).alias("ordinal"), F.get(names, k).alias("rule"), (i + 1).alias("position"), v.alias("value")),
            ),
        )
    )
    return _candidates(df, rules, content).where(F.size("__rules") > 0).select(*key, F.inline(tried))
