"""Rule packs as SQL functions, for `spark.sql` over any table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cfgveil.functions.dialect import java_replacement
from cfgveil.rules import Rule, RulePack


def quoted(value: str) -> str:
    """A raw SQL string literal; where the value holds a quote, one with escapes."""
    if "'" not in value:
        return f"r'{value}'"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def guarded(rule: Rule, text: str, value: str, otherwise: str) -> str:
    """`value` where the text holds a literal of the rule, as `Rule.guard` has it."""
    if not rule.literals:
        return value
    seen = f"lower({text})" if rule.ignores_case else text
    tests = [f"contains({seen}, {quoted(x)})" for x in rule.literals]
    if rule.ignores_case:
        tests += [f"contains({text}, '{c}')" for c in ("\u017f", "\u0131", "\u0130")]
    return f"if({' or '.join(tests)}, {value}, {otherwise})"


def register_pack(spark: SparkSession, pack: RulePack, prefix: str | None = None) -> list[str]:
    """Temporary SQL functions of a pack, named by `prefix` (the pack's name); returns their names.

    `<prefix>_text(text)` is the text with every rule applied in order. `<prefix>_findings(text)`
    is a table function, used after LATERAL: (ordinal, rule, position, value), all matches of
    each rule on the given text, the value being the match's last group. `<prefix>_rules()` is
    the pack as a table. They are expressions to Spark, not Python: filters and pruning pass.
    A null text gives null and no findings.
    """
    name = prefix or pack.name
    steps = "text"
    for rule in pack.rules:  # inside out; each step names the text before it once
        steps = f"regexp_replace({steps}, {quoted(rule.java())}, {quoted(java_replacement(rule.replacement, rule.pattern))})"
    found = [
        "transform("
        + guarded(r, "text", f"regexp_extract_all(text, {quoted(r.java())}, {r.detected_group()})", "cast(array() as array<string>)")
        + f", (v, i) -> named_struct('ordinal', {k}, 'rule', {quoted(r.name)}, 'position', i + 1, 'value', v))"
        for k, r in enumerate(pack.rules, 1)
    ]
    rows = ", ".join(f"({k}, {quoted(r.name)}, {quoted(r.pattern)}, {quoted(r.change_label)})" for k, r in enumerate(pack.rules, 1))
    bodies = {
        f"{name}_text(text STRING) RETURNS STRING": steps,
        f"{name}_findings(text STRING) RETURNS TABLE (ordinal INT, rule STRING, position INT, value STRING)": f"SELECT inline(flatten(array({', '.join(found)})))",
        f"{name}_rules() RETURNS TABLE (ordinal INT, rule STRING, pattern STRING, label STRING)": f"SELECT * FROM VALUES {rows}",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in bodies]
