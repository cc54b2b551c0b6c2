"""Compiling ordered rules into a chain of native columns.

Each rule is two columns over the text as the previous rule left it: how often it
matches, and the rewritten text. A rule costs one `contains` on texts without its
literal, and a text without any literal of the pack skips all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cfgveil.rules import Rule, any_of, odd_folding

FINDINGS_TYPE = "array<struct<ordinal:int,rule:string,label:string,n:bigint>>"
ODD = "__odd_folding"
GATE = "__gate"


@dataclass
class Chain:
    """A DataFrame under rewriting: the text column of the moment and the counts so far."""

    df: DataFrame
    text: str
    counts: list[tuple[Rule, str]]

    @property
    def next_text(self) -> str:
        return f"__text_{int(self.text.rsplit('_', 1)[1]) + 1}"

    def with_text(self, column: Column) -> Chain:
        return Chain(self.df.withColumn(self.next_text, column), self.next_text, self.counts)


def start_chain(df: DataFrame, content: str, rules: Sequence[Rule], when: Column | None = None) -> Chain:
    """Begin a chain over `content`; rows where `when` is false are left as they are."""
    allowed = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    df = (
        df.withColumn("__text_0", F.col(content))
        .withColumn(ODD, odd_folding(F.col(content)))
        .withColumn("__folded", F.lower(F.col(content)))
        .withColumn(GATE, allowed & pack_gate(F.col("__folded"), rules))
        .drop("__folded")
    )
    return Chain(df, "__text_0", [])


def pack_gate(folded: Column, rules: Iterable[Rule]) -> Column:
    """False only where no rule of the chain can match.

    The first rule to match sees the original text, so a text that holds no literal of
    any rule leaves the chain unchanged. One rule without a literal opens the gate.
    """
    rules = list(rules)
    if not rules or not all(r.literals for r in rules):
        return F.lit(bool(rules))
    everything = sorted({x.lower() for r in rules for x in r.literals})
    # A literal that contains another one adds nothing to the gate.
    shortest = [x for x in everything if not any(y in x and y != x for y in everything)]
    return any_of([F.contains(folded, F.lit(x)) for x in shortest]) | F.col(ODD)


def apply_rule(chain: Chain, rule: Rule, *, counts: bool = True, where: Column | None = None) -> Chain:
    """One rule, one projection: count its matches on the current text and rewrite it."""
    text = F.col(chain.text)
    guard = rule.guard(text, F.lower(text), F.col(ODD))
    able = F.col(GATE) if where is None else F.col(GATE) & where
    if guard is not None:
        able = able & guard
    rewritten = F.when(able, rule.rewrite(text)).otherwise(text)
    if not counts:
        return chain.with_text(rewritten)
    name = f"__n_{len(chain.counts)}"
    count = F.when(able, rule.count(text)).otherwise(F.lit(0)).cast("bigint")
    df = chain.df.withColumns({name: count, chain.next_text: rewritten})
    if rule.only_if_changed:
        same = F.col(chain.next_text) == text
        df = df.withColumn(name, F.when(same, F.lit(0)).otherwise(F.col(name)))
    return Chain(df, chain.next_text, [*chain.counts, (rule, name)])


# Separates the entries of a constant list of names (see `_names`).
_SEPARATOR = "\u0001"


def _names(values: Sequence[str]) -> Column:
    """A constant array of strings, folded by the optimizer, in two calls instead of one per name."""
    return F.split(F.lit(_SEPARATOR.join(values)), _SEPARATOR)


def findings_array(counts: Sequence[tuple[Rule, str]]) -> Column:
    """The rules that matched, in order, as array<struct<ordinal, rule, label, n>>."""
    if not counts:
        return F.array().cast(FINDINGS_TYPE)
    rules, labels = _names([r.name for r, _ in counts]), _names([r.change_label for r, _ in counts])
    every = F.transform(
        F.array(*[name for _, name in counts]),
        lambda n, i: F.struct(
            (i + 1).alias("ordinal"), F.get(rules, i).alias("rule"), F.get(labels, i).alias("label"), n.alias("n")
        ),
    )
    return F.filter(every, lambda e: e["n"] > 0)


def messages_array(counts: Sequence[tuple[Rule, str]]) -> Column:
    """`label: N replaced` per label in order of first appearance, zero totals left out."""
    if not counts:
        return F.array().cast("array<string>")
    columns: dict[str, list[str]] = {}
    verbs: dict[str, str] = {}
    for rule, name in counts:
        columns.setdefault(rule.change_label, []).append(name)
        verbs.setdefault(rule.change_label, rule.verb)
    labels, ends = _names(list(columns)), _names(list(verbs.values()))
    totals = F.array(*[F.expr(" + ".join(names)) for names in columns.values()])
    every = F.transform(
        totals,
        lambda n, i: F.when(
            n > 0, F.concat(F.get(labels, i), F.lit(": "), n.cast("string"), F.lit(" "), F.get(ends, i))
        ),
    )
    return F.array_compact(every)


def pinned(df: DataFrame, keep: Sequence[str], computed: dict[str, Column]) -> DataFrame:
    """`keep` plus `computed`, with the computed columns fixed behind a one-element inline.

    A predicate on a computed column would otherwise be pushed down through the chain,
    where every level names the previous one several times: the condition grows
    exponentially with the number of rules. Predicates stop above the inline.
    """
    fields = [column.alias(name) for name, column in computed.items()]
    return df.select(*keep, F.inline(F.array(F.struct(*fields))))
