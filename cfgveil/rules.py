"""Rules and rule packs: small ordered data that operators compile into columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cfgveil.functions.ambiguity import Ambiguity, ambiguity
from cfgveil.functions.dialect import capture_groups, java_pattern, java_replacement

RULE_SCHEMA = (
    "pack string, ordinal int, name string, pattern string, replacement string, "
    "flags array<string>, description string, change_label string"
)


@dataclass(frozen=True)
class Rule:
    """One rewrite rule.

    ``pattern``, ``counted`` and ``replacement`` are in Python's dialect. ``engine_pattern``
    (Java's dialect, without flags) replaces ``pattern`` where the plain translation
    would be unsafe or slow on long texts. Every match holds at least one of ``literals``
    (lower-case ASCII if the rule ignores case); they guard the regex. ``secret_group`` names
    the group that holds the secret where that is not the last one.
    """

    name: str
    pattern: str
    replacement: str
    flags: tuple[str, ...] = ()
    description: str | None = None
    label: str | None = None
    verb: str = "replaced"
    literals: tuple[str, ...] = ()
    counted: str | None = None
    engine_pattern: str | None = None
    secret_group: int | None = None
    any_case_flags: bool = True
    only_if_changed: bool = False

    @property
    def change_label(self) -> str:
        return self.label or self.description or self.name

    @property
    def ignores_case(self) -> bool:
        return "i" in self._prefix()

    def _prefix(self) -> str:
        return java_pattern("", self.flags, any_case=self.any_case_flags)

    def java(self) -> str:
        if self.engine_pattern is not None:
            return self._prefix() + self.engine_pattern
        return java_pattern(self.pattern, self.flags, any_case=self.any_case_flags)

    def java_counted(self) -> str:
        """The pattern whose matches are counted: the original one unless stated otherwise."""
        if self.counted is None:
            return self.java()
        return java_pattern(self.counted, self.flags, any_case=self.any_case_flags)

    def java_template(self) -> str:
        return java_replacement(self.replacement, self.pattern)

    def detected_group(self) -> int:
        return capture_groups(self.pattern)

    # Column forms -------------------------------------------------------------------

    def guard(self, text: Column, folded: Column, odd_folding: Column) -> Column | None:
        """A cheap necessary condition for a match, or None when the rule names no literal.

        ``folded`` is the text in lower case. ``odd_folding`` marks texts holding one of
        the few non-ASCII letters that fold to an ASCII one; there a case-insensitive
        rule skips the guard.
        """
        if not self.literals:
            return None
        seen = folded if self.ignores_case else text
        hit = any_of([F.contains(seen, F.lit(x)) for x in self.literals])
        return (hit | odd_folding) if self.ignores_case else hit

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.java_counted()))

    def rewrite(self, text: Column) -> Column:
        return F.regexp_replace(text, self.java(), self.java_template())


def any_of(conditions: Iterable[Column]) -> Column:
    out = None
    for condition in conditions:
        out = condition if out is None else out | condition
    return F.lit(False) if out is None else out


def odd_folding(text: Column) -> Column:
    """True where ``lower`` could hide an ASCII letter from a guard (long s, Turkish i)."""
    return any_of([F.contains(text, F.lit(c)) for c in ("\u017f", "\u0131", "\u0130")])


@dataclass(frozen=True)
class RulePack:
    """An ordered set of rules; the order of the tuple is the order of execution."""

    name: str
    rules: tuple[Rule, ...]
    service_accounts: tuple[str, ...] = ()
    personal_accounts: tuple[str, ...] = ()

    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def override(self, extra: Iterable[Rule]) -> RulePack:
        """Last write wins per name; a replaced rule keeps its place in the order."""
        by_name = {r.name: r for r in self.rules}
        by_name.update((r.name, r) for r in extra)
        return replace(self, rules=tuple(by_name.values()))

    def subset(self, names: Iterable[str] | None) -> RulePack:
        """The named rules in the order given; unknown names are skipped, none means all."""
        if not names:
            return self
        by_name = {r.name: r for r in self.rules}
        return replace(self, rules=tuple(by_name[n] for n in names if n in by_name))


    def merge(self, other: RulePack) -> RulePack:
        """Accounts of both packs, and rules of both with the other's winning per name."""
        return replace(
            self.override(other.rules),
            service_accounts=tuple(dict.fromkeys((*self.service_accounts, *other.service_accounts))),
            personal_accounts=tuple(dict.fromkeys((*self.personal_accounts, *other.personal_accounts))),
        )


def pack_from_settings(name: str, settings: Mapping) -> RulePack:
    """A pack from the settings of a user's rule file; settings of other kinds are ignored.

    Personal accounts are put in name order, so that pseudonyms do not depend on how a
    set happened to be listed.
    """
    return RulePack(
        name,
        custom_rules(settings.get("patterns", {})),
        tuple(dict.fromkeys(settings.get("service_accounts", ()))),
        tuple(sorted(set(settings.get("personal_accounts", ())))),
    )


def custom_rules(mapping: Mapping[str, Mapping]) -> tuple[Rule, ...]:
    """User rules ``{name: {pattern, replacement, flags?, description?}}`` for the sanitize path.

    Their change label quotes the rule name, and flag names count only in upper case.
    """
    return tuple(_user_rule(name, data) for name, data in mapping.items())


def library_rules(mapping: Mapping[str, Mapping]) -> tuple[Rule, ...]:
    """User rules for the detect / apply path: label is the description, any-case flags."""
    return tuple(
        replace(
            _user_rule(name, data), label=None, any_case_flags=True, only_if_changed=True
        )
        for name, data in mapping.items()
    )


def _user_rule(name: str, data: Mapping) -> Rule:
    allowed = {"pattern", "replacement", "flags", "description", "literals", "secret_group"}
    unknown = set(data) - allowed
    if unknown:
        raise TypeError(f"rule {name!r} has unknown settings: {sorted(unknown)}")
    return Rule(
        name=name,
        pattern=data["pattern"],
        replacement=data["replacement"],
        flags=tuple(data.get("flags") or ()),
        description=data.get("description"),
        label=f"Custom pattern '{name}'",
        literals=tuple(data.get("literals") or ()),
        secret_group=data.get("secret_group"),
        any_case_flags=False,
    )


def rules_frame(spark: SparkSession, packs: Iterable[RulePack]) -> DataFrame:
    """The rules of some packs as a table."""
    rows = [
        (p.name, i, r.name, r.pattern, r.replacement, list(r.flags), r.description, r.change_label)
        for p in packs
        for i, r in enumerate(p.rules, 1)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rule_problems(spark: SparkSession, rules: Iterable[Rule]) -> dict[str, str | None]:
    """Per rule name, why it cannot run, or None. Checked in both dialects before a plan is built."""
    problems: dict[str, str | None] = {}
    trials: dict[str, Column] = {}
    for rule in rules:
        try:
            found = F.regexp_count(F.lit("x"), F.lit(rule.java()))
            changed = F.regexp_replace(F.lit("x"), rule.java(), rule.java_template())
            trials[rule.name] = F.struct(found, changed)
            problems[rule.name] = None
        except (re.error, ValueError, KeyError) as problem:
            problems[rule.name] = f"{type(problem).__name__}: {problem}"
    if _engine_problem(spark, trials.values()):
        # Some rule is refused by the engine only: find out which.
        for name, trial in trials.items():
            problems[name] = _engine_problem(spark, [trial])
    return problems


def _engine_problem(spark: SparkSession, trials: Iterable[Column]) -> str | None:
    try:
        spark.range(1).select(F.array(*[t.cast("string") for t in trials])).collect()
    except Exception as problem:  # noqa: BLE001 - Spark raises one of several classes
        return str(problem).splitlines()[0]
    return None


# A quantified group around an alternation, not possessive: Java recurses once per
# repetition, so a long text can exhaust the thread stack.
_RECURSIVE_GROUP = re.compile(r"\((?:\?:)?[^()]*(?:\||\\n|\n)[^()]*\)[*+]\??(?!\+)")


def recursion_risk(rule: Rule) -> bool:
    return rule.engine_pattern is None and bool(_RECURSIVE_GROUP.search(rule.pattern))


def rule_ambiguity(rule: Rule) -> Ambiguity:
    """Whether the pattern that runs can read a text in many ways."""
    flags = re.NOFLAG
    for letter, flag in (("i", re.IGNORECASE), ("m", re.MULTILINE), ("s", re.DOTALL)):
        flags |= flag if letter in rule._prefix().split(")")[0] else re.NOFLAG
    return ambiguity(rule.engine_pattern or rule.pattern, flags)
