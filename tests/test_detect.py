import re
import time

import brute
import pytest
from test_sanitize import random_text

from cfgveil import BUILTIN, LIBRARY, STRICT, RulePack, custom_rules
from cfgveil.functions.ambiguity import ambiguity
from cfgveil.functions.sql import register_pack
from cfgveil.operators import detect as det
from cfgveil.packs import VENDOR_PACKS
from cfgveil.rules import Rule, rule_ambiguity

SAMPLES = [
    "enable secret 5 $1$a$b\nusername u privilege 1 secret 5 Q\n",
    "tacacs-server host 1.1.1.1 key 7 abc\nRADIUS key 12345\nnext word",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\n-----BEGIN CERTIFICATE-----\nx\n-----END CERTIFICATE-----",
    '<Password>x</password> {"token" : "abc"} postgresql://u:p@h ' + "A" * 44 + "== ",
    "password is " + "0123456789abcdef" * 3 + " API-KEY=abc_1 ldap x password Z aws_secret_access_key = AK wpa-passphrase pp\n",
    "interface Gi0/1\n description clean\n",
]


def expected(text, pack, limit):
    out = []
    for i, rule in enumerate(pack.rules, 1):
        found = brute.compiled(rule).findall(text)
        values = [m[-1] if isinstance(m, tuple) else m for m in found][:limit]
        out += [(i, rule.name, k, v) for k, v in enumerate(values, 1)]
    return out


def test_detections_match_plain_python(texts):
    df = texts(SAMPLES + [random_text(i) for i in range(150)] + ["snmp-server community x\n" * 25])
    for limit, found in ((None, det.detect_secrets(df, ["path"])), (10, det.detection_preview(df, ["path"]))):
        got = {}
        for r in found.collect():
            got.setdefault(r.path, []).append((r.ordinal, r.rule, r.position, r.value))
        for row in df.collect():
            assert sorted(got.get(row.path, [])) == expected(row.content, LIBRARY, limit)


def test_all_values_and_secret_group(texts):
    df = texts(["snmp-server community x\n" * 25, "postgresql://user:hidden@host"])
    every = det.detect_secrets(df, ["path"], shown=None, secret_group=True).collect()
    assert sum(r.rule == "snmp_community" for r in every) == 25
    assert [r.value for r in every if r.rule == "database_url"] == ["hidden"]


def test_map_form(texts):
    row = det.detections_map(texts([SAMPLES[0], SAMPLES[-1]]), ["path"]).orderBy("path").collect()
    assert row[0].detections == {"enable_secret": [" $1$a$b"], "username_secret": [" Q"]}
    assert row[1].detections == {}


def test_stats_match_plain_python(texts):
    df = texts(SAMPLES + [random_text(i) for i in range(150)])
    got = {(r.path, r.rule): r.n for r in det.pattern_stats(df, ["path"]).collect()}
    want = {(row.path, r.name): n for row in df.collect() for r in LIBRARY.rules if (n := len(brute.compiled(r).findall(row.content)))}
    assert got == want


def test_audit(texts):
    rules = [*custom_rules({"a": {"pattern": r"enable \S+", "replacement": "x"}, "none": {"pattern": "zzz", "replacement": "x"}}), Rule("bad", "(", "x")]
    rows = {r.rule: r for r in det.rule_audit(texts(SAMPLES), rules).collect()}
    assert (rows["a"].valid, rows["a"].hits, rows["a"].files) == (True, 1, 1)
    assert (rows["none"].hits, rows["none"].files) == (0, 0)
    assert not rows["bad"].valid and rows["bad"].problem


def test_audit_of_an_empty_corpus(texts, spark):
    empty = spark.createDataFrame([], "path string, content string")
    rows = det.rule_audit(empty, LIBRARY.rules).collect()
    assert len(rows) == 20 and all(r.hits == 0 and r.files == 0 for r in rows)


def test_coverage(texts):
    packs = [RulePack("one", custom_rules({"e": {"pattern": "enable", "replacement": ""}, "u": {"pattern": "username", "replacement": ""}})),
             RulePack("two", custom_rules({"z": {"pattern": "zzz", "replacement": ""}}))]
    rows = {r.pack: r for r in det.pack_coverage(texts(SAMPLES), packs).collect()}
    assert (rows["one"].rules, rows["one"].rules_hit, rows["one"].hits, rows["one"].files) == (2, 2, 2, 1)
    assert (rows["two"].rules_hit, rows["two"].hits, rows["two"].files) == (0, 0, 0)


def test_every_match_is_returned(texts):
    df = texts(["\n".join(f"snmp-server community name{i} RO" for i in range(25))])
    pack = LIBRARY.subset(["snmp_community"])
    assert det.detect_secrets(df, ["path"], pack).count() == 25
    assert det.detection_preview(df, ["path"], pack).count() == 10
    assert len(det.detections_map(df, ["path"], pack).first().detections["snmp_community"]) == 25


BAD = {
    r"(a+)+b": "exponential", r"(a|a)*c": "exponential", r"(\w+\s?)*x": "exponential", r"(a|b|ab)*c": "exponential", r"(a{1,30})*b": "exponential",
    r"([a-z]+)*\d": "exponential", r"^(\d+,?)+$": "exponential", r"a*a*b": "quadratic", r"\s*\n?\s*$": "quadratic", r"\d+\d+x": "quadratic", r".*.*=": "quadratic",
    r"(?:a|b)+c": "none", r"a*b": "none", r"(ab)*c": "none", r"\w+@\w+\.\w+": "none", r"(a?){20}b": "none", r"(?>a+)+b": "none", r"(a++)+b": "none",
    r"(\d+)?(\s*)(\S+)": "none", r"^(?=x)a+$": "none", r"(\S+ )*\S+=": "none", r"(a)\1": "unknown", r"(?<=x)(a|a)+b": "exponential",
}


@pytest.mark.parametrize("pattern", list(BAD))
def test_ambiguity(pattern):
    found = ambiguity(pattern)
    assert found.kind == BAD[pattern] and (found.witness() is None) == (found.kind in ("none", "unknown"))
    if found.witness():
        assert not re.compile(pattern).fullmatch(found.witness(8))


def test_a_witness_shows_its_growth():
    def seconds(found, pattern, times):
        start = time.perf_counter()
        re.compile(pattern).match(found.witness(times))
        return time.perf_counter() - start

    for pattern in (r"(a+)+b", r"(\w+\s?)*x", r"(a|b|ab)*c"):
        found = ambiguity(pattern)
        size = 36 // len(found.pump) // 2
        assert seconds(found, pattern, size + 4) > 4 * seconds(found, pattern, size)
    found = ambiguity(r"a*a*b")
    assert seconds(found, r"a*a*b", 8000) > 6 * seconds(found, r"a*a*b", 2000)


def test_the_packs_are_not_ambiguous():
    """One rule is quadratic, in a run of white space between a keyword and its secret."""
    kinds = {(p.name, r.name): rule_ambiguity(r).kind for p in (BUILTIN, STRICT, LIBRARY, *VENDOR_PACKS.values()) for r in p.rules}
    assert {k for k, kind in kinds.items() if kind != "none"} == {("builtin", "juniper_psk")}


def test_many_rules_are_the_same_as_unrolled(spark):
    flags = ((), ("IGNORECASE",), ("MULTILINE",))
    rules = [Rule(f"r{k}", rf"(?:key|Tag)?{w}(\d*)", "x", flags=flags[k % 3], literals=(w.lower() if k % 3 == 1 else w,) if k % 7 else ()) for k, w in enumerate(["aB", "cd", "Kel", "x y", "é", "ss", "Q1", "zz", "s"] * 4)]
    texts_ = ["ab aB12 AB CD cd9 x y", "KEL kel Kel3", "ſS ss Q1 zz", "", None, "nothing here: é é5", "tagzz1 Tagzz2 keyQ1"]
    df = spark.createDataFrame(list(enumerate(texts_)), "path int, content string")
    pack = RulePack("p", tuple(rules))
    assert sorted(det.pattern_stats_indexed(df, ["path"], rules).collect()) == sorted(det.pattern_stats(df, ["path"], pack).collect())
    assert sorted(det.detect_secrets_indexed(df, ["path"], rules).collect()) == sorted(det.detect_secrets(df, ["path"], pack).collect())
    size = [det.pattern_stats_indexed(df, ["path"], rules * n)._jdf.queryExecution().analyzed().toString().count("\n") for n in (1, 20)]
    assert size[0] == size[1]


def test_packs_in_sql(spark, texts):
    text, findings, rules = register_pack(spark, RulePack("own", custom_rules({
        "quote": {"pattern": r"say '(\w+)\\?'", "replacement": r"say '<\1>'", "literals": ["say '"]},
        "low": {"pattern": r"secret (\S+)", "replacement": "secret -", "flags": ["IGNORECASE"], "literals": ["secret "]},
    })))
    texts({"/a": "say 'hi' SECRET x\nsay 'no'", "/b": "none", "/c": None}).createOrReplaceTempView("sql_texts")
    assert {r[0]: r[1] for r in spark.sql(f"select path, {text}(content) from sql_texts").collect()} == {"/a": "say '<hi>' secret -\nsay '<no>'", "/b": "none", "/c": None}
    found = spark.sql(f"select t.path, f.* from sql_texts t, lateral {findings}(t.content) f").collect()
    assert sorted(tuple(r) for r in found) == [("/a", 1, "quote", 1, "hi"), ("/a", 1, "quote", 2, "no"), ("/a", 2, "low", 1, "x")]
    assert [tuple(r)[:2] for r in spark.sql(f"select * from {rules}() order by ordinal").collect()] == [(1, "quote"), (2, "low")]
