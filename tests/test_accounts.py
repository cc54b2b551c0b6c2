import random

import pytest

from cfgveil import BUILTIN
from cfgveil.operators import accounts as acc
from cfgveil.operators import occurrences as occ
from cfgveil.operators import sanitize as san

USER_RULE = BUILTIN.rules[1]
NAMES = ["ann", "annette", "bob.w", "jo hn", "x", "admin", "carol", "verylongaccountname", "né"]


def corpus(n=120):
    rng = random.Random(3)
    words = [*NAMES, "annex", "bob", "the", "lorem", "net", "jo", "hn"]
    rows = {f"/c/{i}": " ".join(rng.choice(words) + rng.choice(["", ".", "1", "\n"]) for _ in range(rng.randint(0, 30))) for i in range(n)}
    rows["/c/blob"] = "z" * 700 + "annette" + "y" * 900 + "verylongaccountname" + "carol" * 200
    rows["/c/empty"] = ""
    return rows


def renamed(text, names):
    """Names found in the text before renaming are replaced one after the other."""
    known, messages = [], []
    for name in [n for n in names if n in text]:
        if name not in text:
            continue
        known.append(name)
        alias = f"netadmin{len(known)}"
        messages.append(f"Username {name} -> {alias} ({text.count(name)} occurrences)")
        text = text.replace(name, alias)
    return text, messages


def collected(df):
    rows = df.select("path", "renamed", acc.rename_messages(df.hits).alias("m")).collect()
    return {r.path: (r.renamed, r.m) for r in rows}


WAYS = pytest.mark.parametrize("inline, chars", [(512, 1000), (0, 1000), (0, 0)], ids=["in-row", "automaton", "join"])


def way(monkeypatch, inline, chars):
    monkeypatch.setattr(acc, "INLINE_ACCOUNTS", inline)
    monkeypatch.setattr(occ, "AUTOMATON_CHARS", chars)


@WAYS
def test_renaming_matches_brute_force(texts, spark, monkeypatch, inline, chars):
    way(monkeypatch, inline, chars)
    rows = corpus()
    got = collected(acc.rename_accounts(texts(rows), acc.accounts_frame(spark, NAMES)))
    assert got == {p: renamed(t, NAMES) for p, t in rows.items()}


@pytest.mark.parametrize("chars", [1000, 20, 0])
def test_occurrences_match_brute_force(texts, spark, monkeypatch, chars):
    monkeypatch.setattr(occ, "AUTOMATON_CHARS", chars)
    rows = corpus()
    got = {(r.path, r.username): r.n for r in acc.occurring_accounts(texts(rows), acc.accounts_frame(spark, NAMES)).collect()}
    assert got == {(p, u): t.count(u) for p, t in rows.items() for u in NAMES if u in t}
    totals = {r.username: (r.occurrences, r.files) for r in acc.account_occurrences(texts(rows), acc.accounts_frame(spark, NAMES)).collect()}
    assert totals["ann"] == (sum(t.count("ann") for t in rows.values()), sum("ann" in t for t in rows.values()))


@pytest.mark.parametrize("chars", [10_000, 40, 0])
def test_literals_of_any_kind(texts, spark, chars):
    rng = random.Random(8)
    literals = ["a", "aa", "aba", "ab ab", " ", "\n", "é", "x" * 300, "ab" * 140, "b a", "none of it", "", "a"]
    rows = {f"/{k}": "".join(rng.choice(["a", "b", "ab", " ", "\n", "é", "😀"]) for _ in range(rng.randint(0, 60))) for k in range(60)}
    rows |= {"/long": "x" * 2000 + "ab" * 900 + "😀" * 300 + "aba", "/none": None, "/empty": ""}
    listed = spark.createDataFrame([(x,) for x in literals], "literal string")
    got = {(r.path, r.literal): r.n for r in occ.literal_counts(texts(rows), listed, automaton_chars=chars).collect()}
    assert got == {(p, x): t.count(x) for p, t in rows.items() for x in set(literals) if x and t and x in t}


def test_no_join_carries_a_text(texts, spark, monkeypatch):
    """The plans' joins: whatever they join, `content` is not among its columns."""
    for chars in (1000, 0):
        monkeypatch.setattr(occ, "AUTOMATON_CHARS", chars)
        found = acc.account_occurrences(texts(corpus()), acc.accounts_frame(spark, [n for n in NAMES if " " not in n]))
        assert _content_joins(found) == 0
    way(monkeypatch, 0, 1000)
    assert _content_joins(acc.rename_accounts(texts(corpus()), acc.accounts_frame(spark, NAMES))) == 0
    way(monkeypatch, 0, 0)
    assert _content_joins(acc.rename_accounts(texts(corpus()), acc.accounts_frame(spark, NAMES))) == 1


def _content_joins(df):
    joins = []

    def walk(node):
        if node.nodeName() == "Join":
            out = node.output()
            joins.append(any(out.apply(i).name() == "content" for i in range(out.size())))
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().optimizedPlan())
    return sum(joins)


def test_merge_keeps_one_row_per_account(spark):
    a = acc.accounts_frame(spark, ["p", "q"], ["s"])
    b = acc.accounts_frame(spark, ["q", "r"], ["s", "t"])
    got = sorted((r.username, r.kind, r.ordinal) for r in acc.merge_accounts(a, b).collect())
    assert got == [("p", "personal", 1), ("q", "personal", 1), ("r", "personal", 2), ("s", "service", 1), ("t", "service", 2)]


LINES = "username zed secret 5 A\n! ann\nusername ann privilege 1 password 7 B\nusername admin secret 5 C\n  username bob secret 0 D x\nusername ann secret 5 E\nno username f secret 5 G\n"


def test_lines_and_numbers(texts, spark):
    lines = acc.username_lines(texts([LINES]), USER_RULE)
    assert [(r.line_no, r.username) for r in lines.orderBy("line_no").collect()] == [(1, "zed"), (3, "ann"), (4, "admin"), (5, "bob"), (6, "ann")]
    accounts = acc.accounts_frame(spark, ["bob", "ann", "admin"], ["admin"])
    assert [r.username for r in acc.members_of(lines, accounts, "service").collect()] == ["admin"]
    numbers = {r.username: r.alias for r in acc.pseudonyms(lines, accounts).collect()}
    assert numbers == {"ann": "netadmin1", "bob": "netadmin2"}


def test_one_numbering_per_file(texts):
    row = san.sanitize(texts(["! carol\n" + LINES]), personal=["ann", "bob", "carol"]).first()
    assert row.sanitized.startswith("! netadmin3\nusername zed secret 5 <removed-user-secret>\n! netadmin1\nusername netadmin1 privilege")
    assert "  username netadmin2 secret 0 <removed-user-secret>\n" in row.sanitized
    assert row.changes[-2:] == ["Username ann -> netadmin1 (1 occurrences)", "Username carol -> netadmin3 (1 occurrences)"]


def test_line_names_are_renamed_whole(texts):
    row = san.sanitize(texts(["username joann secret 5 X\njoann ann\n"]), personal=["ann", "joann"]).first()
    assert row.sanitized == "username netadmin1 secret 5 <removed-user-secret>\njonetadmin2 netadmin2\n"


def test_service_accounts_keep_their_line_but_not_the_rest(texts):
    row = san.sanitize(texts(["username ops secret 5 X\n"]), personal=["ops"], service=["ops"]).first()
    assert row.sanitized == "username netadmin1 secret 5 <removed-user-secret>\n"


def test_server_blocks(texts):
    text = "tacacs server A\n address x\n   key 7 K1\n key 7 K2\n!\n key 7 K3\nradius server B\n key 0 R\nTACACS server C\n timeout\nend\n"
    rows = acc.server_block_keys(texts([text]), "tacacs").collect()
    assert [(r.block, r.line_no, r.key_type, r.secret) for r in rows] == [("A", 3, "7", "K1")]
    rows = acc.server_block_keys(texts([text]), "radius").collect()
    assert [(r.block, r.line_no, r.key_type, r.secret) for r in rows] == [("B", 8, "0", "R")]
    both = acc.server_block_keys(texts([text, None, "", "x\n" * 20_000 + text]), ["tacacs", "radius"])
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    rows = [(r.path, r.service, r.block, r.line_no) for r in both.collect()]
    assert sorted(rows) == [("/c/f0.conf", "radius", "B", 8), ("/c/f0.conf", "tacacs", "A", 3), ("/c/f3.conf", "radius", "B", 20_008), ("/c/f3.conf", "tacacs", "A", 20_003)]


@WAYS
def test_renaming_after_sanitizing_is_the_same(texts, spark, monkeypatch, inline, chars):
    rng = random.Random(5)
    lines = [*LINES.split("\n"), "! carol and bob", "  username carol privilege 1 password 7 Z", "joann bobann", "username joann secret 5 X"]
    df = texts(["\n".join(rng.sample(lines, rng.randint(1, len(lines)))) for _ in range(80)])
    names, service = ["ann", "bob", "carol", "joann", "zed"], ["zed"]
    want = {r.path: (r.sanitized, [c for c in r.changes if c.startswith("Username ")]) for r in san.sanitize(df, personal=names, service=service).collect()}
    way(monkeypatch, inline, chars)
    done = san.sanitize(df).select("path", "sanitized")
    named = acc.rename_accounts(done, acc.accounts_frame(spark, names, service), content="sanitized", user_lines=True)
    assert collected(named) == want


def test_long_account_lists_give_the_same_rows(spark, monkeypatch):
    from cfgveil.operators.sanitize import sanitize

    names = [f"user{i:04d}x" for i in range(700)] + ["admin", 'q"uo\\te', "bob"]
    texts = [
        "username bob secret 5 X\n! bob and user0699x\n", "username user0003x password 7 0011\nuser0600x admin user0003x\n", 'a q"uo\\te b\n', "", None,
        "username admin secret 5 Y\n",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "path int, content string")

    def run(limit):
        monkeypatch.setattr(acc, "INLINE_ACCOUNTS", limit)
        done = sanitize(df, personal=names[-40:], service=["admin"])
        return sorted(map(tuple, done.select("path", "sanitized", "changes", "change_count").collect()))

    assert run(512) == run(3)
    monkeypatch.setattr(acc, "INLINE_ACCOUNTS", 512)
    many = {r.path: r.sanitized for r in sanitize(df, personal=names, service=["admin"]).collect()}
    assert "bob" not in many[0] and "user0699x" not in many[0] and "user0600x" not in many[1] and 'q"uo' not in many[2] and many[3] == "" and many[4] is None


def test_only_what_texts_hold_travels(texts, spark):
    """Long lists: no text is exploded into tokens or substrings, blanks and windows across places included."""
    rows = {"/a": "x " * (occ.PLACES_AT_ONCE // 2 - 1) + "ab cd" * 3 + "é", "/b": "é ab", "/c": "cd"}
    listed = spark.createDataFrame([("ab cd",), ("é",), ("b cda",), ("q" * 50,)], "literal string")
    found = occ.literal_counts(texts(rows), listed, automaton_chars=0)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.path, r.literal): r.n for r in found.collect()} == {("/a", "ab cd"): 3, ("/a", "é"): 1, ("/a", "b cda"): 2, ("/b", "é"): 1}
