import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_sanitize import random_text

from cfgveil.operators import ranking
from cfgveil.operators import report as rep
from cfgveil.operators import sanitize as san


@pytest.fixture
def run(spark):
    rows = [(f"arc{0 if i % 3 else i % 2}", f"/c/d{i % 7}/f{i % 50}.cfg#{i}", random_text(i)) for i in range(120)]
    df = spark.createDataFrame([(a, p.split("#")[0] + p.split("#")[1], t) for a, p, t in rows], "archive string, path string, content string")
    return san.sanitize(df, personal=["bob"]).cache()


def test_totals_agree(run):
    files = run.collect()
    total = sum(f.n for r in files for f in r.findings)
    by_type = {r.label: (r.total_count, r.affected_files) for r in rep.secrets_by_type(run).collect()}
    assert sum(n for n, _ in by_type.values()) == total
    want = Counter()
    names = {}
    for r in files:
        for f in r.findings:
            want[f.label] += f.n
            names.setdefault(f.label, set()).add(r.path.rsplit("/", 1)[1])
    assert by_type == {k: (n, len(names[k])) for k, n in want.items()}
    s = rep.security_summary(run).first()
    assert (s.total_secrets_found, s.files_containing_secrets, s.secret_types_detected) == (total, sum(bool(r.findings) for r in files), len(want))
    # The report is what its messages say.
    parsed = Counter()
    for r in run.select(F.explode("changes").alias("c")).select(rep.parse_change(F.col("c")).alias("p")).collect():
        parsed[r.p.type] += r.p["count"]
    assert parsed == want


def test_json_document(run):
    lines = rep.report_lines(run, "2024-01-01T00:00:00", "json").orderBy("archive", "section", "idx").collect()
    for archive in ("arc0", "arc1"):
        document = json.loads("\n".join(r.line for r in lines if r.archive == archive))
        files = [r for r in run.collect() if r.archive == archive]
        assert document["archive_info"]["total_files_extracted"] == len(files)
        hit = sorted((r for r in files if r.modified), key=lambda r: (-r.change_count, r.path))
        assert [(f["filename"], f["changes"]) for f in document["file_details"]] == [(r.path.rsplit("/", 1)[1], r.change_count) for r in hit]
        sums = Counter()
        for f in document["file_details"]:
            sums.update(f["secrets_by_type"])
        assert {k: v["total_count"] for k, v in document["secrets_by_type"].items()} == dict(sums)
        assert list(document["secrets_by_type"]) == [k for k, _ in sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))]


def test_empty_report(texts):
    clean = san.sanitize(texts(["hostname x\n"]).withColumn("archive", F.lit("a")))
    for fmt in rep.FORMATS:
        rows = rep.report_lines(clean, "2024-01-01T00:00:00", fmt).orderBy("section", "idx").collect()
        text = "\n".join(r.line for r in rows)
        assert "MODIFIED FILES" not in text and "Modified Files" not in text
        if fmt == "json":
            assert json.loads(text)["file_details"] == []


def test_text_document(texts):
    df = texts(["enable secret 5 A\n"]).withColumn("archive", F.lit("z.zip"))
    rows = rep.report_lines(san.sanitize(df), "NOW", "txt").orderBy("section", "idx").collect()
    text = "\n".join(r.line for r in rows).split("\n")
    assert text[3:7] == ["", "Generated: NOW", "Tool: cfgveil", ""]
    assert text[-13:] == ["", "-" * 80, "MODIFIED FILES", "-" * 80, "", "1. f0.conf", "   Total Changes: 1", "   Secrets Found:",
                          "     - Enable secrets: 1", "", "=" * 80, "END OF REPORT", "=" * 80]


def test_parse_change(spark):
    cases = {"TACACS keys: 3 replaced": ("TACACS keys", 3), "SNMP communities: 12 checked": ("SNMP communities", 12), "no colon 4 replaced": ("unknown", 1),
             "Odd: nothing": ("Odd", 1), "Username a -> b (2 occurrences)": ("unknown", 1), "A: b: 7 replaced": ("A", 7)}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", rep.parse_change(F.col("c")).alias("p"))
    assert {r.c: (r.p.type, r.p["count"]) for r in df.collect()} == cases


def test_numbering_spreads_one_hot_group(spark):
    rows = [("hot" if i % 10 else f"g{i % 3}", i * 7919 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    done = ranking.numbered(df, ["g"], [F.desc("v"), F.asc("id")])
    want, totals = {}, Counter(r[0] for r in rows)
    for g in totals:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = k
    got = done.collect()
    assert {r.id: r.idx for r in got} == want
    assert all(r.total == totals[r.g] for r in got)


def test_top_changed_and_stats(run):
    rows = rep.results(run)
    top = rep.top_changed(rows).collect()
    assert [r.change_count for r in top] == sorted((r.change_count for r in run.collect()), reverse=True)[:5]
    s = rep.run_stats(rows).first()
    assert (s.files_processed, s.files_modified, s.errors) == (120, run.filter("modified").count(), 0)


def test_sketches_add_up(spark):
    """Parts counted on their own and added up are within the stated error of one run over all."""
    rows = [(f"/d{d}/f{k}.cfg", f"f{k}.cfg", d, "enable secret 5 A\n" * (1 + k % 2)) for d in range(3) for k in range(d * 400, 2000 + d * 400)]
    done = san.sanitize(spark.createDataFrame(rows, "path string, filename string, day int, content string"))
    whole = rep.secrets_by_type(done).collect()
    merged = rep.merged_sketches(rep.label_sketches(done, ["day"])).collect()
    assert [(r.label, r.total_count) for r in merged] == [(r.label, r.total_count) for r in whole]
    assert whole[0].affected_files == 2800 and abs(merged[0].affected_files - 2800) < 3 * 0.02 * 2800
    days = {r.day: r.affected_files for r in rep.merged_sketches(rep.label_sketches(done, ["day"]), ["day"]).collect()}
    assert set(days) == {0, 1, 2} and all(abs(n - 2000) < 3 * 0.02 * 2000 for n in days.values())
    few = rep.merged_sketches(rep.label_sketches(done.where("filename in ('f1.cfg', 'f900.cfg')"))).first()
    assert few.affected_files == 2
