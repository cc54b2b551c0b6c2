"""Small single-text checkers in plain Python, written for the tests only."""

import re

FLAGS = {"IGNORECASE": re.I, "MULTILINE": re.M, "DOTALL": re.S}


def compiled(rule, pattern=None):
    names = [f.upper() if rule.any_case_flags else f for f in rule.flags]
    return re.compile(pattern or rule.pattern, sum(FLAGS.get(n, 0) for n in names))


def apply(rules, text):
    """(text, {rule: count}) after the rules, with Python's own regular expressions."""
    counts = {}
    for rule in rules:
        counter = compiled(rule, rule.counted)
        counts[rule.name] = len(counter.findall(text))
        # The one rule whose engine form means something else than its pattern: an open
        # community is kept and what follows it is not swallowed.
        kept = rule.engine_pattern if rule.name == "snmp_community" else None
        text = compiled(rule, kept).sub(rule.replacement, text)
    return text, {k: v for k, v in counts.items() if v}
