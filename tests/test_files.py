import gzip
import io
import json
import re
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cfgveil import custom_rules, jobs
from cfgveil.functions.text import decode_text, file_stem, file_suffix, sanitized_name, token_hash
from cfgveil.operators import backups as bak
from cfgveil.operators.archives import expand_archives
from cfgveil.packs import SAMPLE_BASIC
from cfgveil.rules import RulePack
from cfgveil.sinks import files as sinks
from cfgveil.sources import files as src
from cfgveil.sources.stores import list_folder
from cfgveil.streaming import streams as st

NOW = datetime(2024, 5, 6, 7, 8, 9)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub dir").mkdir(parents=True)
    files = {
        "a.txt": b"enable secret 5 X\r\nline\r", "b.CONF": b"clean\n", "c.Cfg": b"caf\xc3\xa9 \xff\xfe ok", "d.cFg": b"never found",
        "e.log": b"not a config", "empty.cfg": b"", "sub dir/f.config": b"snmp-server community s RO\n", "sub dir/g+1%.txt": b"",
    }
    for name, body in files.items():
        (root / name).write_bytes(body)
    return root


def names(df):
    return sorted(r.filename for r in df.collect())


def test_scan_finds_case_variants_and_empty_files(spark, folder):
    found = src.scan_configs(spark, str(folder))
    assert names(found) == ["a.txt", "b.CONF", "c.Cfg", "empty.cfg", "f.config", "g+1%.txt"]
    rows = {r.filename: r.content for r in found.collect()}
    assert rows["a.txt"] == "enable secret 5 X\nline\n"
    assert rows["c.Cfg"] == "café  ok"
    assert rows["empty.cfg"] == rows["g+1%.txt"] == ""


def test_scan_options(spark, folder):
    root = str(folder)
    assert names(src.scan_configs(spark, root, recursive=False)) == ["a.txt", "b.CONF", "c.Cfg", "empty.cfg"]
    assert names(src.scan_configs(spark, root, ["*.log"])) == ["e.log"]
    assert "empty.cfg" not in names(src.scan_configs(spark, root, include_empty=False))
    raw = {r.filename: r.content for r in src.scan_configs(spark, root, normalize_newlines=False).collect()}
    assert raw["a.txt"] == "enable secret 5 X\r\nline\r"
    assert names(src.list_files(spark, root, ["*.txt"])) == ["a.txt"]


def test_glob_variants():
    assert src.glob_variants(["*.cfg", "running-config"]) == "{*.cfg,*.CFG,*.Cfg,running-config}"


def test_missing_inputs_and_file_list(spark, folder):
    found = src.scan_configs(spark, str(folder))
    requested = spark.createDataFrame([("/gone/x.txt",), ("/gone/x.txt",), (found.first().path,)], "path string")
    assert [tuple(r) for r in src.missing_inputs(requested, found).collect()] == [("/gone/x.txt", "File not found: /gone/x.txt")]
    paths = [r.path for r in src.file_list(found.unionByName(found)).collect()]
    assert paths == sorted(set(paths)) and len(paths) == 6


def test_decode_drops_invalid_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xc3\r\nc\rd"),)], "c binary")
    assert df.select(decode_text(F.col("c"))).first()[0] == "ab\nc\nd"
    assert df.select(decode_text(F.col("c"), normalize_newlines=False)).first()[0] == "ab\r\nc\rd"


def test_names(spark):
    df = spark.createDataFrame([("/x/r1.tar.gz",), ("/x/r1_sanitized.zip",), (".profile",), ("/x/name",), ("plain.txt",)], "p string")
    rows = df.select(file_stem(F.col("p")).alias("stem"), file_suffix(F.col("p")).alias("suffix"), sanitized_name(F.col("p")).alias("out")).collect()
    assert [tuple(r) for r in rows] == [
        ("r1.tar", ".gz", "/x/r1.tar_sanitized.gz"), ("r1_sanitized", ".zip", "/x/r1_sanitized.zip"),
        (".profile", "", ".profile_sanitized"), ("name", "", "/x/name_sanitized"), ("plain", ".txt", "plain_sanitized.txt"),
    ]


def test_token_hash(spark):
    import hashlib

    got = spark.range(1).select(token_hash(F.lit("snmp"), F.lit(3))).first()[0]
    assert got == hashlib.md5(b"snmp_3").hexdigest()[:12].upper()


# Jobs -------------------------------------------------------------------------------


def test_folder_job(spark, folder, tmp_path):
    out, table = str(tmp_path / "out"), str(tmp_path / "backups")
    requested = spark.createDataFrame([("/gone.txt",)], "path string")
    rows = jobs.sanitize_folder(spark, str(folder), out, pack=SAMPLE_BASIC, requested=requested, backup_table=table, backup_dir="/bk", now=NOW)
    got = {r.file.rsplit("/", 1)[1]: r for r in rows.collect()}
    assert len(got) == 7
    assert got["a.txt"].modified and got["a.txt"].changes == ["Enable secrets: 1 replaced"]
    assert got["f.config"].modified and not got["b.CONF"].modified and not got["empty.cfg"].modified
    assert got["gone.txt"].error == "File not found: /gone.txt"
    assert got["a.txt"].backup.startswith("/bk/a_20240506_070809_") and got["a.txt"].backup.endswith("..txt.gz")
    catalog = bak.read_catalog(spark, table)
    assert {r.backup_path for r in catalog.collect()} == {r.backup for n, r in got.items() if n != "gone.txt"}
    texts = {r.filename: r.content for r in spark.read.parquet(out + "/texts").collect()}
    assert texts["a.txt"] == "enable secret 5 <removed-enable-secret>\nline\n"
    assert (folder / "a.txt").read_bytes() == b"enable secret 5 X\r\nline\r"


def test_jobs_leave_no_scratch_tables(spark, folder, archive_folder, tmp_path):
    from cfgveil.session import shared_dir

    def left():
        return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if not re.fullmatch(r"[0-9a-f-]{36}", p.name)}

    before = left()
    table = str(tmp_path / "backups")
    jobs.sanitize_folder(spark, str(folder), str(tmp_path / "out"), backup_table=table).collect()
    jobs.sanitize_archive_folder(spark, str(archive_folder), str(tmp_path / "reports"))
    jobs.sanitize_archive_folder(spark, str(archive_folder), str(tmp_path / "packed"), fmt="zip").collect()
    wanted = spark.createDataFrame([(f"file:{folder}",)], "directory string")
    assert jobs.restore(spark, table, str(tmp_path / "back"), directories=wanted).count() > 0
    assert left() == before


def test_dry_run_writes_nothing(spark, folder, tmp_path):
    rows = jobs.sanitize_folder(spark, str(folder), str(tmp_path / "out"), backup_table=str(tmp_path / "bk"), dry_run=True)
    assert rows.filter("modified").count() == 2
    assert not (tmp_path / "out").exists() and not (tmp_path / "bk").exists()


def test_restore_job(spark, folder, tmp_path):
    table = str(tmp_path / "backups")
    for hour in (1, 2):
        (folder / "a.txt").write_text(f"version {hour}\n")
        bak.append_backup(src.scan_configs(spark, str(folder)), table, "/bk", NOW.replace(hour=hour))
    found = src.scan_configs(spark, str(folder))
    wanted = found.filter("filename = 'a.txt'").select("path").unionByName(spark.createDataFrame([("/gone",)], "path string"))
    jobs.restore(spark, table, str(tmp_path / "r1"), files=wanted)
    got = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "r1")).collect()}
    assert got["a.txt"].content == "version 2\n" and not got["gone"].restored
    jobs.restore(spark, table, str(tmp_path / "r2"), files=wanted, date_prefix="20240506_01")
    got = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "r2")).collect()}
    assert got["a.txt"].content == "version 1\n"
    below = found.filter("filename = 'f.config'").select(F.regexp_replace("path", "/[^/]*$", "/").alias("directory"))
    restored = jobs.restore(spark, table, str(tmp_path / "r3"), directories=below)
    assert sorted(r.path.rsplit("/", 1)[1] for r in restored.collect()) == ["f.config", "g+1%.txt"]


@pytest.fixture
def archive_folder(tmp_path):
    root = tmp_path / "archives"
    root.mkdir()
    for name, n in (("one.zip", 3), ("two_sanitized.ZIP", 1)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i in range(n):
                z.writestr(f"d/r{i}.cfg", f"enable secret 5 S{i}\nhostname r{i}\nsnmp-server community q RO\n" * (i + 1))
            z.writestr("running-notes.bin", "enable secret 5 hidden\n")
            z.writestr("image.png", b"\x89PNG\xff")
        (root / name).write_bytes(out.getvalue())
    (root / "x.cfg.gz").write_bytes(gzip.compress(b"enable secret 5 Z\n"))
    (root / "broken.zip").write_bytes(b"PK nothing")
    return root


def test_archive_job_with_reports(spark, archive_folder, tmp_path):
    out = str(tmp_path / "out")
    result = {r.archive.rsplit("/", 1)[1]: (r.extracted_files, r.sanitized_files, r.errors) for r in
              jobs.sanitize_archive_folder(spark, str(archive_folder), out, generated_at="2024-05-06T07:08:09").collect()}
    assert result == {"one.zip": (5, 4, 0), "two_sanitized.ZIP": (3, 2, 0), "x.cfg.gz": (1, 1, 0), "broken.zip": (0, 0, 1)}
    documents = {}
    for part in sorted((tmp_path / "out/reports/json").glob("archive=*/part-*")):
        documents[part.parent.name] = documents.get(part.parent.name, "") + part.read_text()
    one = json.loads(next(v for k, v in documents.items() if k.endswith("one.zip")))
    assert one["archive_info"]["total_files_extracted"] == 4
    assert one["security_summary"] == {"total_secrets_found": 13, "files_containing_secrets": 4, "secret_types_detected": 2}
    assert one["secrets_by_type"]["Enable secrets"] == {"total_count": 7, "affected_files": 4}
    assert one["file_details"][0] == {"filename": "r0.cfg", "changes": 2, "secrets_by_type": {"Enable secrets": 1, "SNMP communities": 1}}
    assert [f["filename"] for f in one["file_details"]] == ["r0.cfg", "r1.cfg", "r2.cfg", "running-notes.bin"]


def test_archive_job_with_packing(spark, archive_folder, tmp_path):
    out = str(tmp_path / "out")
    jobs.sanitize_archive_folder(spark, str(archive_folder), out, fmt="tar.gz", patterns=["*.cfg"])
    from cfgveil.operators.archives import expand_archives

    packed = spark.read.parquet(out + "/archives").select(F.col("output_path").alias("path"), "content")
    got = {(r.archive.rsplit("/", 1)[1], r.member): bytes(r.content) for r in expand_archives(packed).collect()}
    assert got["one_sanitized.tar.gz", "d/r0.cfg"] == b"enable secret 5 <removed-enable-secret>\nhostname r0\nsnmp-server community <removed-snmp-community> RO\n"
    assert got["one_sanitized.tar.gz", "running-notes.bin"] == b"enable secret 5 hidden\n"
    assert got["two_sanitized.tar.gz", "image.png"] == b"\x89PNG\xff"
    assert got["x.cfg_sanitized.tar.gz", "x.cfg"] == b"enable secret 5 <removed-enable-secret>\n"


def test_sinks(spark, folder, tmp_path):
    from cfgveil.operators import report as rep
    from cfgveil.operators.sanitize import sanitize

    done = sanitize(src.scan_configs(spark, str(folder)))
    rows = rep.results(done)
    sinks.write_results_json(rows, str(tmp_path / "j"), stats_out=str(tmp_path / "s"))
    stats = spark.read.json(str(tmp_path / "s")).first()
    assert (stats.files_processed, stats.files_modified, stats.total_changes, stats.errors) == (6, 2, 2, 0)
    sinks.write_results_csv(rows, str(tmp_path / "c"))
    back = spark.read.json(str(tmp_path / "j"))
    assert {"file", "modified", "changes", "change_count", "error", "backup", "duration"} <= set(back.columns)
    csv = {r.File: r for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()}
    assert (csv["a.txt"].Modified, csv["a.txt"].Changes, csv["a.txt"].Duration) == ("Yes", "1", None)
    sinks.write_sanitized(done, str(tmp_path / "t"), fmt="text", partition_by=["filename"], only_modified=True)
    assert sorted(r.filename for r in spark.read.text(str(tmp_path / "t")).select("filename").distinct().collect()) == ["a.txt", "f.config"]


# Streams ----------------------------------------------------------------------------


def test_stream_of_files_is_processed_once(spark, folder, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = st.sanitize_stream(st.config_stream(spark, str(folder)), custom=RulePack("p", custom_rules({"l": {"pattern": "clean", "replacement": "CLEAN"}})))
        return st.run_to_table(stream.select("filename", "sanitized", "modified"), out, check)

    first = {r.filename: r.sanitized for r in run().collect()}
    assert first["a.txt"].startswith("enable secret 5 <removed-enable-secret>\n") and first["b.CONF"] == "CLEAN\n"
    (folder / "late.txt").write_text("snmp-server community new RO\n")
    second = run()
    assert second.count() == len(first) + 1
    assert second.filter("filename = 'late.txt'").first().sanitized == "snmp-server community <removed-snmp-community> RO\n"


def test_rollup_stream_keeps_running_totals(spark, tmp_path):
    source = tmp_path / "drop"
    source.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        return {r.label: (r.total_count, r.affected_files) for r in
                st.run_rollup(st.findings_rollup(st.sanitize_stream(st.config_stream(spark, str(source)))), out, check).collect()}

    assert run() == {}
    (source / "a.txt").write_text("enable secret 5 A\nenable secret 5 B\ntacacs-server key K\ntacacs server T\n key 7 Z\n")
    assert run() == {"Enable secrets": (2, 1), "TACACS keys": (2, 1)}
    (source / "b.txt").write_text("enable secret 5 A\n")
    assert run() == {"Enable secrets": (3, 2), "TACACS keys": (2, 1)}
    for folder in ("x", "y"):  # equal base names count once, in one batch and across batches
        (source / folder).mkdir()
        (source / folder / "r.conf").write_text("enable secret 5 A\n")
    assert run() == {"Enable secrets": (5, 3), "TACACS keys": (2, 1)}
    (source / "x" / "a.txt").write_text("enable secret 5 A\n")
    assert run() == {"Enable secrets": (6, 3), "TACACS keys": (2, 1)}


def test_log_redaction(spark):
    from cfgveil.functions.logs import SENSITIVE_WORDS, redact_log

    cases = ["user=a password=b c", "plain a=b", "TOKEN x = y z=1=2 =q", "key", "multi line key=\nx=y z", "secret= a==b  c=d", ""]

    def plain(m):
        if any(w in m.lower() for w in SENSITIVE_WORDS) and "=" in m:
            return " ".join(p.split("=", 1)[0] + "=<redacted>" if "=" in p else p for p in m.split(" "))
        return m

    df = spark.createDataFrame([(c,) for c in cases], "m string")
    assert [r[0] for r in df.select(redact_log(F.col("m"))).collect()] == [plain(c) for c in cases]


def test_globs_select_as_the_scan_does(spark, tmp_path):
    names = ["a.txt", "b.TXT", "c1.cfg", "c2.cfg", "cx.cfg", "d,e.log", "f+g.log", "h_i.log", "hxi.log", "plain"]
    for name in names:
        (tmp_path / name).write_text("x")
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for glob in ("*.txt", "c[12].cfg", "c[^12].cfg", "c[1-9].cfg", "{a,plain}*", "f+g.*", "h_i.lo?", "*.{log,cfg}"):
        chosen = sorted(r.name for r in df.collect() if any(re.fullmatch(src.glob_regex(g), r.name, re.S) for g in src.variants([glob])))
        assert chosen == sorted(r.filename for r in src.list_files(spark, str(tmp_path), [glob]).collect()), glob
        native = df.where(jobs._selected(F.col("name"), [glob]))
        assert sorted(r.name for r in native.collect()) == chosen


def test_files_above_the_cell_limit_are_error_rows(spark, tmp_path):
    """Spark ends a job that asks for the content of a file above maxLength."""
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.cfg").write_text("hostname a\n")
    (root / "long.cfg").write_text("hostname b\n" * 1000)
    (root / "empty.cfg").write_text("")
    for name, size in (("a.zip", 10), ("long.zip", 5000)):
        with zipfile.ZipFile(root / name, "w") as archive:
            archive.writestr("m.cfg", "x" * size)
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "1000")
    try:
        found = {r.filename: (r.content, r.error) for r in src.scan_configs(spark, str(root)).collect()}
        members = {r.archive.rsplit("/", 1)[1]: (r.member, r.error) for r in expand_archives(src.scan_archives(spark, str(root))).collect()}
        done = {r.file.rsplit("/", 1)[1]: r.error for r in jobs.sanitize_folder(spark, str(root), str(tmp_path / "out"), backup_table=str(tmp_path / "bak")).collect()}
        manifest = src.list_files(spark, str(root), ["*.cfg"]).select("path", "length").union(spark.createDataFrame([(f"file:{root}/empty.cfg", 0)], "path string, length long"))
        by_manifest = {r.filename: (r.content, r.error) for r in src.scan_configs(spark, str(root), manifest=manifest).collect()}
    finally:
        spark.conf.unset(key)
    assert found == by_manifest == {"a.cfg": ("hostname a\n", None), "empty.cfg": ("", None), "long.cfg": (None, src.TOO_LONG)}
    assert members == {"a.zip": ("m.cfg", None), "long.zip": (None, "Archive exceeds the size limit of one cell")}
    assert done == {"a.cfg": None, "empty.cfg": None, "long.cfg": src.TOO_LONG}


def test_the_executors_list_a_folder(spark, tmp_path):
    root = tmp_path / "deep"
    want = {}
    for k in range(60):
        folder = root / f"a{k % 4}" / f"b{k % 3}" / ("_hidden" if k % 20 == 0 else "c")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f {k}%+é.cfg").write_bytes(b"x" * k)
        if k % 20:
            want[f"file:{folder}/f {k}%+é.cfg"] = k
    (root / ".crc").write_text("x")
    assert {r.path: r.length for r in list_folder(spark, str(root)).collect()} == want
    assert list_folder(spark, str(root), recursive=False).collect() == []
    assert list_folder(spark, f"file://{root}/a1/b1/c/").count() == sum("/a1/b1/c/" in p for p in want)
    assert {r.path for r in src.list_files(spark, str(root)).collect()} == {p for p, n in want.items() if n}
    with pytest.raises(ValueError, match="manifest"):
        src.scan_configs(spark, f"{root}/a*")


def test_files_are_written_one_by_one(spark, tmp_path):
    df = spark.createDataFrame([("/r/x/a.cfg", "A"), ("/r/b.cfg", ""), ("/r/né.cfg", "é\n")], "path string, sanitized string").repartition(2)
    got = {r.path: r.length for r in sinks.write_files(df, str(tmp_path / "out"), root="/r").collect()}
    assert got == {f"file:{tmp_path}/out/x/a.cfg": 1, f"file:{tmp_path}/out/b.cfg": 0, f"file:{tmp_path}/out/né.cfg": 3}
    assert (tmp_path / "out" / "né.cfg").read_bytes() == "é\n".encode() and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["b.cfg", "né.cfg", "x"]


def test_a_stream_survives_files_above_the_limit(spark, tmp_path):
    root, out, check = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "check")
    root.mkdir()
    (root / "a.cfg").write_text("enable secret 5 A\n")
    (root / "long.cfg").write_text("enable secret 5 A\n" * 1000)
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "1000")
    try:
        def run():
            done = st.sanitize_stream(st.config_stream(spark, str(root))).select("filename", "sanitized", "error")
            return [sorted((r.filename, r.sanitized, r.error) for r in t.collect()) for t in st.run_with_errors(done, out, check)]

        clean = "enable secret 5 <removed-enable-secret>\n"
        assert run() == [[("a.cfg", clean, None)], [("long.cfg", None, src.TOO_LONG)]]
        (root / "b.cfg").write_text("enable secret 5 B\n")
        assert run() == [[("a.cfg", clean, None), ("b.cfg", clean, None)], [("long.cfg", None, src.TOO_LONG)]]
    finally:
        spark.conf.unset(key)


def test_rollup_reads_no_earlier_batch(spark, tmp_path):
    """Two epochs of totals at most, a row a label each; a repeated batch changes nothing."""
    source, out, check = tmp_path / "drop", tmp_path / "out", tmp_path / "check"
    source.mkdir()
    for k in range(6):
        (source / f"{k}").mkdir()
        (source / f"{k}" / f"r{k % 2}.cfg").write_text("enable secret 5 A\ntacacs-server key K\n")

    def run():
        stream = st.config_stream(spark, str(source), files_per_batch=1)
        rows = st.run_rollup(st.findings_rollup(st.sanitize_stream(stream)), str(out), str(check)).collect()
        return {r.label: (r.total_count, r.affected_files) for r in rows}

    want = {"Enable secrets": (6, 2), "TACACS keys": (6, 2)}
    assert run() == want
    assert sorted(p.name for p in out.iterdir()) == ["epoch=4", "epoch=5"]
    for name in ("5", ".5.crc"):  # the last batch's commit was lost: it runs again
        (check / "commits" / name).unlink()
    assert run() == want


def test_folders_are_listed_and_read_by_the_executors(spark, tmp_path, monkeypatch):
    """Spark's own reader would hold every path on the driver and open files in tasks of 32."""
    monkeypatch.setattr(src, "_binary", lambda *_: pytest.fail("listed on the driver"))
    for k in range(40):
        (tmp_path / f"{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 3}" / f"r {k}.cfg").write_text(f"hostname {k}\n" if k else "")
    got = {r.filename: (r.content, r.error) for r in src.scan_configs(spark, str(tmp_path)).collect()}
    assert got == {f"r {k}.cfg": (f"hostname {k}\n" if k else "", None) for k in range(40)}
    assert src.scan_configs(spark, str(tmp_path), include_empty=False).count() == 39
    asked = spark.createDataFrame([(f"file:{tmp_path}/1/r 1.cfg",), ("/no/such.cfg",)], "path string")
    rows = jobs.sanitize_folder(spark, str(tmp_path), str(tmp_path / "out"), requested=asked, dry_run=True)
    assert [r.file for r in rows.where("error is not null").collect()] == ["/no/such.cfg"] and rows.count() == 41


def test_a_drop_folder_is_one_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.cfg").write_text("hostname a\n")
    query = (st.config_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert len(query.lastProgress["sources"]) == 1
    assert [r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["hostname a\n"]


def test_written_configs_are_files_of_their_own(spark, tmp_path):
    from cfgveil.plans import fixtures as fx

    rows = [(1, "a", 2), (1, "a", 2), (2, None, None)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    fx.written_configs(spark, str(tmp_path), str(tmp_path / "out"))
    found = src.scan_configs(spark, str(tmp_path / "out")).select(F.regexp_extract("path", fx.WRITTEN_NAME, 1).alias("name"), "content").collect()
    want = [r.content or "\n" for r in fx.configs(spark, str(tmp_path)).collect()]
    assert sorted(r.name for r in found) == ["R-1.CFG", "R-1.CFG", "R-2.txt"] and sorted(r.content for r in found) == sorted(want)


def test_rollup_calls_no_python_per_key_and_survives_lost_totals(spark, tmp_path, monkeypatch):
    import shutil

    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda *_, **__: pytest.fail("a Python call for each key"))
    source, out, check = tmp_path / "drop", tmp_path / "out", tmp_path / "check"
    source.mkdir()

    def run():
        stream = st.findings_rollup(st.sanitize_stream(st.config_stream(spark, str(source))))
        return {r.label: (r.total_count, r.affected_files) for r in st.run_rollup(stream, str(out), str(check)).collect()}

    for name in "ab":
        (source / f"{name}.cfg").write_text("enable secret 5 A\n")
        last = run()
    assert last == {"Enable secrets": (2, 2)}
    # Killed after the new names were kept, before the totals of that batch were written.
    shutil.rmtree(out / "epoch=1")
    for name in ("1", ".1.crc"):
        (check / "commits" / name).unlink()
    assert run() == last


def test_a_drop_folder_is_listed_by_the_executors(spark, tmp_path):
    """Spark's file source would hold every path on the driver, and list each of them again."""
    root = tmp_path / "drop"
    want = set()
    for k, folder in enumerate((".", "x", "x/one/way/down", "x/one/way/down/p", "x/one/way/down/q", "y", "y/a", "y/b/c", ".hidden", "_later")):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for name in (f"r {k}.cfg", f"r{k}.TXT", f"r{k}.log", f"_r{k}.cfg", f".r{k}.cfg"):
            (root / folder / name).write_text(f"hostname {folder}/{name}\n")
            if name[0] == "r" and not name.endswith(".log") and folder[0] not in "_" and folder != ".hidden":
                want.add(f"hostname {folder}/{name}\n")
    (root / "y" / "empty.cfg").write_text("")
    seen = []

    def run():
        query = (st.config_stream(spark, str(root)).writeStream.foreachBatch(lambda batch, _: seen.append(sorted(r.content for r in batch.collect())))
                 .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
        query.awaitTermination()
        assert all("File" not in s["description"] for s in query.lastProgress["sources"])

    run()
    (root / "y" / "a" / "late.cfg").write_text("late\n")
    (root / "y" / "a" / "r 6.cfg").write_text("changed, not new\n")
    run()
    run()
    assert seen == [sorted(want), ["late\n"], []]


def test_a_table_of_a_stream_keeps_a_repeated_batch_once(spark, tmp_path):
    source, out, check = tmp_path / "drop", str(tmp_path / "out"), tmp_path / "check"
    source.mkdir()

    def run():
        stream = st.config_stream(spark, str(source)).select(F.col("filename").alias("epoch"), "content")
        return sorted(r.epoch for r in st.run_to_table(stream, out, str(check)).collect())

    (source / "a.cfg").write_text("a\n")
    assert run() == ["a.cfg"]
    (source / "b.cfg").write_text("b\n")
    assert run() == ["a.cfg", "b.cfg"]
    for name in ("1", ".1.crc"):  # killed before the batch was noted; meanwhile a file arrives
        (check / "commits" / name).unlink()
    (source / "c.cfg").write_text("c\n")
    assert run() == run() == ["a.cfg", "b.cfg", "c.cfg"]


def test_writing_files_leaves_nothing_else(spark, tmp_path):
    from cfgveil.sources.stores import write_bodies

    df = spark.createDataFrame([(f"{k % 3}/r{k}.cfg", bytearray(b"x")) for k in range(30)], "name string, body binary").repartition(4)
    assert write_bodies(df, str(tmp_path / "out")).count() == 30
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0", "1", "2"]
    assert len([*(tmp_path / "out").rglob("*.cfg")]) == len([p for p in (tmp_path / "out").rglob("*") if p.is_file()]) == 30
