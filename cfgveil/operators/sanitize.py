"""Sanitizing a corpus: built-in rules, custom rules, then account renaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cfgveil.operators import accounts as acc
from cfgveil.operators.chain import (
    FINDINGS_TYPE,
    Chain,
    apply_rule,
    findings_array,
    messages_array,
    pinned,
    start_chain,
)
from cfgveil.packs import BUILTIN, LIBRARY, vendor_pack
from cfgveil.rules import Rule, RulePack

USER_RULE = "user_secret"


def _user_lines(builtin: RulePack) -> Rule | None:
    return next((r for r in builtin.rules if r.name == USER_RULE), None)


def sanitize(
    df: DataFrame,
    *,
    builtin: RulePack = BUILTIN,
    custom: RulePack | Sequence[Rule] = (),
    personal: Sequence[str] | None = None,
    service: Sequence[str] | None = None,
    content: str = "content",
    when: Column | None = None,
) -> DataFrame:
    """Rewrite every text of a corpus; adds the result columns to the input's columns.

    `custom` is a pack (its accounts apply unless `personal` / `service` are given) or a
    list of rules, run after the built-in ones. Rows where `when` is false pass unchanged.
    Account lists of any length give rows by the same rules; each text is searched for every
    name, so tables of many thousand names are better joined (`accounts.rename_accounts`).
    Result columns: sanitized, modified, changes (messages, empty unless modified),
    change_count and findings (one struct per rule that matched, empty unless modified).
    The input's own columns, the original text included, are kept.
    """
    custom_rules = custom.rules if isinstance(custom, RulePack) else tuple(custom)
    if isinstance(custom, RulePack):
        personal = custom.personal_accounts if personal is None else personal
        service = custom.service_accounts if service is None else service
    personal, service = tuple(dict.fromkeys(personal or ())), tuple(service or ())

    chain = start_chain(df, content, [*builtin.rules, *custom_rules], when)
    user_rule = _user_lines(builtin)
    for rule in builtin.rules:
        before = chain.text
        chain = apply_rule(chain, rule)
        if personal and rule is user_rule:
            chain = acc.rename_step(chain, rule, before, personal, service)
    for rule in custom_rules:
        chain = apply_rule(chain, rule)
    return _results(_rename(chain, personal, when), df.columns, content)


def _rename(chain: Chain, personal: Sequence[str], when: Column | None) -> Chain:
    if not personal:
        return chain
    text = F.col(chain.text)
    found = acc.contained(text, personal)
    if when is not None:
        found = F.when(when, found).otherwise(F.array().cast("array<string>"))
    known = F.col("__line_names") if "__line_names" in chain.df.columns else F.array().cast("array<string>")
    df = chain.df.withColumn("__found", found)
    fold = F.when(F.size("__found") > 0, acc.renamed(text, known, F.col("__found")))
    df = df.withColumn("__fold", fold)
    return Chain(df, chain.text, chain.counts).with_text(F.coalesce(F.col("__fold.text"), text))


def _results(chain: Chain, keep: Sequence[str], content: str) -> DataFrame:
    df = chain.df
    findings, messages = findings_array(chain.counts), messages_array(chain.counts)
    if "__fold" in df.columns:
        hits = F.coalesce(
            F.col("__fold.hits"), F.array().cast("array<struct<username:string,alias:string,n:bigint>>")
        )
        # A rename message carries no label before a colon, so reports file it under
        # "unknown" and count it once.
        first = len(chain.counts) + 1
        renames = F.transform(
            hits,
            lambda h, i: F.struct(
                (i + first).cast("int").alias("ordinal"),
                F.lit("account").alias("rule"),
                F.lit("unknown").alias("label"),
                F.lit(1).cast("bigint").alias("n"),
            ),
        ).cast(FINDINGS_TYPE)
        findings = F.concat(findings.cast(FINDINGS_TYPE), renames)
        messages = F.concat(messages, acc.rename_messages(hits))
    modified = ~F.col(content).eqNullSafe(F.col(chain.text))
    df = df.withColumn("__modified", modified)
    none = F.array().cast("array<string>")
    df = df.withColumn("__changes", F.when(F.col("__modified"), messages).otherwise(none))
    return pinned(
        df,
        keep,
        {
            "sanitized": F.col(chain.text),
            "modified": F.col("__modified"),
            "changes": F.col("__changes"),
            "change_count": F.size("__changes"),
            "findings": F.when(F.col("__modified"), findings).otherwise(F.array().cast(FINDINGS_TYPE)),
        },
    )


def sanitize_text(
    df: DataFrame,
    *,
    builtin: RulePack = BUILTIN,
    custom: RulePack | Sequence[Rule] = (),
    content: str = "content",
    into: str = "sanitized",
) -> DataFrame:
    """Only the rewritten text: one regex pass per rule instead of two, nothing counted."""
    custom_rules = custom.rules if isinstance(custom, RulePack) else tuple(custom)
    rules = [*builtin.rules, *custom_rules]
    chain = start_chain(df, content, rules)
    for rule in rules:
        chain = apply_rule(chain, rule, counts=False)
    return pinned(chain.df, df.columns, {into: F.col(chain.text)})


def sanitize_by_vendor(df: DataFrame, vendors: Sequence[str], *, vendor: str = "vendor", content: str = "content") -> DataFrame:
    """One scan over a mixed corpus: each row meets the built-in rules and its vendor's rules."""
    packs = {name.lower(): vendor_pack(name) for name in vendors}
    every = [*BUILTIN.rules, *[r for p in packs.values() for r in p.rules]]
    chain = start_chain(df, content, every)
    for rule in BUILTIN.rules:
        chain = apply_rule(chain, rule)
    for name, pack in packs.items():
        for rule in pack.rules:
            mine = F.coalesce(F.lower(F.col(vendor)) == name, F.lit(False))
            chain = apply_rule(chain, rule, where=mine)
    return _results(chain, df.columns, content)


def apply_library(
    df: DataFrame,
    names: Sequence[str] | None = None,
    *,
    library: RulePack = LIBRARY,
    content: str = "content",
) -> DataFrame:
    """Library replace with all rules or the named ones, in the order given."""
    rules = library.subset(names).rules
    chain = start_chain(df, content, rules)
    for rule in rules:
        chain = apply_rule(chain, rule)
    return _results(chain, df.columns, content)


def findings(results: DataFrame, *keep: str) -> DataFrame:
    """Sanitize results as one row per rule and file: keep columns, ordinal, rule, label, n."""
    return results.select(*keep, F.inline("findings"))


def override_library(extra: Mapping[str, Mapping]) -> RulePack:
    """The library with user rules layered over it; a same-named rule is replaced."""
    from cfgveil.rules import library_rules

    return LIBRARY.override(library_rules(extra))
