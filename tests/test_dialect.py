import re

import pytest
from pyspark.sql import functions as F

from cfgveil.functions.dialect import inline_flags, java_pattern, java_replacement
from cfgveil.rules import Rule, custom_rules, recursion_risk, rule_problems

CASES = [
    (r"(a)(\d+)? x", r"\1-\2", (), "a x a1 x"),
    (r"key (\S+)", r"key $REDACTED \g<1>0", (), "key abc"),
    (r"(k)(?P<word>\w+)", r"\g<word>:\1", (), "kone ktwo"),
    (r"(?P<q>['\"])x(?P=q)", "Q", (), "'x' \"x\" 'x\""),
    (r"key .*", "K", (), "key a\r\nkey b c\n"),
    (r"^\s*x", "L", ("MULTILINE",), "a\rx\n x\u0085x\nx"),
    (r"\S+", "S", (), "a b c"),
    (r"école", "E", ("IGNORECASE",), "ÉCOLE école"),
    (r"[[a]+", "B", (), "[[a]"),
    (r"[^]a]+", "N", (), "]a]xyz]"),
    (r"[a&&b]+", "A", (), "a&b&&"),
    (r"a{,2}b", "R", (), "aaab ab b"),
    (r"end\Z", "Z", (), "end\nend"),
    (r"a.c", r"x\ny\t\\", ("DOTALL",), "a\nc abc"),
    (r"(a)(b)", r"\2\1", (), "abab"),
    (r"\d+", "#", (), "١٢ 12"),
    (r"secret", "S", ("IGNORECASE",), "ſecret SECRET"),
]


@pytest.mark.parametrize(("pattern", "template", "flags", "text"), CASES)
def test_same_result_as_python(spark, pattern, template, flags, text):
    flag = sum({"IGNORECASE": re.I, "MULTILINE": re.M, "DOTALL": re.S}[f] for f in flags)
    java = java_pattern(pattern, flags)
    row = spark.createDataFrame([(text,)], "t string").select(
        F.regexp_replace("t", java, java_replacement(template, pattern)).alias("new"),
        F.regexp_count("t", F.lit(java)).alias("n"),
    ).first()
    assert row.new == re.sub(pattern, template, text, flags=flag)
    assert row.n == len(re.findall(pattern, text, flags=flag))


def test_flag_names():
    assert inline_flags(["ignorecase"], any_case=True) == "(?dUiu)"
    assert inline_flags(["ignorecase"], any_case=False) == "(?dU)"
    assert inline_flags(["ASCII", "I"], any_case=False) == "(?diu)"
    with pytest.raises(ValueError):
        inline_flags(["VERBOSE"], any_case=True)


def test_bad_templates_are_rejected():
    for template in (r"\q", r"\0"):
        with pytest.raises(ValueError):
            java_replacement(template)
    with pytest.raises(KeyError):
        java_replacement(r"\g<missing>", "(a)")


def test_rule_problems(spark):
    rules = [
        Rule("good", r"test \d+ pattern", r"\g<0>"),
        Rule("broken", "test [invalid", "x"),
        Rule("python_only", r"a(?(1)b|c)", "x"),
        Rule("bad_group", "(a)", r"\2"),
    ]
    problems = rule_problems(spark, rules)
    assert problems["good"] is None
    assert all(problems[n] for n in ("broken", "python_only", "bad_group"))


def test_recursion_risk():
    assert recursion_risk(Rule("r", r"(a|b)*c", ""))
    assert recursion_risk(Rule("r", r"x(?:\n y)*?z", ""))
    assert not recursion_risk(Rule("r", r"(?:a|b)c", ""))
    assert not recursion_risk(Rule("r", r"(a)+", ""))


def test_unknown_settings_are_an_error():
    with pytest.raises(TypeError):
        custom_rules({"x": {"pattern": "a", "replacement": "b", "colour": "red"}})
