import random
from datetime import datetime

import pytest

from cfgveil.operators import backups as bak

NOW = datetime(2024, 2, 1, 0, 0, 0)
ROWS = [
    ("/b/1", "/c/x/a.cfg", "20240101_000000", "h1", True, 10), ("/b/2", "/c/x/a.cfg", "20240115_120000", "h2", True, 20),
    ("/b/3", "/c/x/a.cfg", "20240115_180000", "h3", False, 30), ("/b/4", "/c/y.cfg", "20240120_000000", "h4", True, 2_000_000),
    ("/b/5", "/c/xx/z.cfg", "20231201_000000", "h5", True, 5), ("/b/6", "/c/x/deep/er/q.cfg", "20240131_235959", "h6", True, 7),
]


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame(ROWS, "backup_path string, original_path string, timestamp string, file_hash string, compressed boolean, size bigint")


def test_latest_and_asof(catalog):
    assert {r.original_path: r.backup_path for r in bak.latest_backup(catalog).collect()} == {
        "/c/x/a.cfg": "/b/3", "/c/y.cfg": "/b/4", "/c/xx/z.cfg": "/b/5", "/c/x/deep/er/q.cfg": "/b/6"}
    assert {r.backup_path for r in bak.latest_backup(catalog, "20240115").collect()} == {"/b/3"}
    assert {r.backup_path for r in bak.latest_backup(catalog, "20240101").collect()} == {"/b/1"}
    assert bak.latest_backup(catalog, "20240102").count() == 0


def test_restore_directory_is_by_whole_folder_names(spark, catalog):
    wanted = spark.createDataFrame([("/c/x/",), ("/c",), ("/none",), ("/c/y.cfg",)], "directory string")
    got = sorted((r.directory, r.original_path) for r in bak.restore_directory(wanted, catalog).collect())
    everything = sorted({r[1] for r in ROWS})
    assert got == sorted([("/c", p) for p in everything] + [("/c/x", "/c/x/a.cfg"), ("/c/x", "/c/x/deep/er/q.cfg"), ("/c/y.cfg", "/c/y.cfg")])


def test_listing(catalog):
    assert [r.backup_path for r in bak.list_backups(catalog).collect()] == ["/b/6", "/b/4", "/b/3", "/b/2", "/b/1", "/b/5"]
    assert [r.backup_path for r in bak.list_backups(catalog, "/c/x/a.cfg").collect()] == ["/b/3", "/b/2", "/b/1"]


def test_retention(catalog):
    kept = {r.backup_path for r in bak.retained(catalog, NOW, 31).collect()}
    gone = {r.backup_path for r in bak.expired(catalog, NOW, 31).collect()}
    assert gone == {"/b/5"} and kept == {r[0] for r in ROWS} - gone
    exact = datetime(2024, 2, 15, 12, 0, 0)
    assert "/b/2" in {r.backup_path for r in bak.retained(catalog, exact, 31).collect()}
    assert "/b/2" in {r.backup_path for r in bak.expired(catalog, exact.replace(microsecond=1), 31).collect()}
    assert bak.retained(catalog, NOW, 0).count() == len(ROWS) and bak.expired(catalog, NOW, 0).count() == 0


def test_stats(spark, catalog):
    r = bak.backup_stats(catalog).first()
    assert (r.total_backups, r.total_size, r.total_size_mb, r.oldest_backup, r.newest_backup) == (6, 2_000_072, 1.91, "20231201_000000", "20240131_235959")
    r = bak.backup_stats(catalog.filter("false")).first()
    assert (r.total_backups, r.total_size, r.oldest_backup) == (0, 0, None)


def test_backup_names(spark):
    df = spark.createDataFrame([("/c/r1.txt", "abc"), ("/c/plain", "abc")], "path string, content string")
    rows = {r.original_path: r for r in bak.snapshot(df, "/bk/", NOW).collect()}
    assert rows["/c/r1.txt"].backup_path == "/bk/r1_20240201_000000_90015098..txt.gz"
    assert rows["/c/plain"].backup_path == "/bk/plain_20240201_000000_90015098..gz"
    assert bak.snapshot(df, "/bk", NOW, compressed=False).filter("original_path like '%r1%'").first().backup_path == "/bk/r1_20240201_000000_90015098.txt"


def test_root_restores_everything(spark):
    catalog = spark.createDataFrame(
        [("/b/1", "/etc/a.conf", "20240101_000000", "h", False, 1), ("/b/2", "/etc/a.conf", "20240102_000000", "h", False, 1), ("/b/3", "/srv/x/b.conf", "20240101_000000", "h", False, 1)],
        "backup_path string, original_path string, timestamp string, file_hash string, compressed boolean, size long",
    )
    rows = bak.restore_directory(spark.createDataFrame([("/",), ("/srv",)], "directory string"), catalog).collect()
    assert sorted((r.directory, r.backup_path) for r in rows) == [("/", "/b/2"), ("/", "/b/3"), ("/srv", "/b/3")]


def test_drop_expired_removes_days_and_rewrites_the_boundary(spark, tmp_path):
    table = str(tmp_path / "backups")
    df = spark.createDataFrame([("/c/r1.txt", "abc"), ("/c/r2.txt", "")], "path string, content string")
    taken = [datetime(2024, 1, 1), datetime(2024, 1, 16, 11), datetime(2024, 1, 16, 12), datetime(2024, 1, 31, 12)]
    for when in taken:
        bak.append_backup(df, table, "/bk", when)
    now = taken[-1]
    assert bak.drop_expired(spark, table, now, 0) == []
    wanted = sorted(map(tuple, bak.retained(bak.read_catalog(spark, table), now, 15).select("backup_path", "original_path", "content").collect()))
    assert len(wanted) == 4
    assert bak.drop_expired(spark, table, now, 15) == ["2024-01-01", "2024-01-16"]
    assert sorted(map(tuple, bak.read_catalog(spark, table).select("backup_path", "original_path", "content").collect())) == wanted
    assert bak.drop_expired(spark, table, now, 15) == []
    # A call that died between its two renames is finished by the next one.
    (tmp_path / "backups" / "backup_date=2024-01-16").rename(tmp_path / "backups" / "_kept-2024-01-16")
    (tmp_path / "backups" / "_old-2024-01-16").mkdir()
    assert bak.drop_expired(spark, table, now, 15) == []
    assert sorted(map(tuple, bak.read_catalog(spark, table).select("backup_path", "original_path", "content").collect())) == wanted


def test_restore_directory_against_brute_force(spark):
    """Nested, root, equal, absent and look-alike folders, in few and in many ranges."""
    rnd = random.Random(11)
    part = lambda: rnd.choice(["a", "b", "a-x", "a b", "é", "a0", "~"])
    paths = sorted({"/" + "/".join(part() for _ in range(rnd.randint(1, 5))) for _ in range(300)}) + ["rel/a", "rel"]
    folders = sorted({p.rsplit("/", rnd.randint(0, 3))[0] or "/" for p in rnd.sample(paths, 60)}) + ["/", "/none", "/a/", "rel", None]
    rows = [(f"/b/{k}{d}", p, f"2024010{d}_000000", "h", True, 1) for k, p in enumerate(paths) for d in range(1, 4)]
    catalog = spark.createDataFrame(rows, "backup_path string, original_path string, timestamp string, file_hash string, compressed boolean, size bigint").repartition(5)
    names = {f.rstrip("/") or "/" for f in folders if f}
    below = lambda f, p: p == f or p.startswith("/" if f == "/" else f + "/")
    want = sorted((f, p, "20240103_000000") for f in names for p in paths if below(f, p))
    for n in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = bak.restore_directory(spark.createDataFrame([(f,) for f in folders], "directory string"), catalog).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert sorted((r.directory, r.original_path, r.timestamp) for r in got) == want
    assert bak.restore_directory(spark.createDataFrame([], "directory string"), catalog).collect() == []
    assert bak.restore_directory(spark.createDataFrame([("/",)], "directory string"), catalog.limit(0)).collect() == []


def test_contents_are_sorted_in_small_parts(spark, tmp_path, monkeypatch):
    """A task's share of the contents is bounded by their bytes, not by the session's number of partitions."""
    monkeypatch.setattr("cfgveil.session.BROADCAST_BYTES", 0)  # as if many were restored
    table = str(tmp_path / "backups")
    rows = spark.createDataFrame([(f"/c/f{i}.conf", f"{i} " + "x" * 1000) for i in range(60)], "path string, content string")
    bak.append_backup(rows, table, "/b", NOW)
    catalog = bak.read_catalog(spark, table)
    whole = sorted(map(tuple, bak.restore_files(rows, catalog).collect()))
    monkeypatch.setattr(bak, "RESTORED_BYTES", 1500)
    parts = bak.restore_files(rows, catalog)
    assert sorted(map(tuple, parts.collect())) == whole and [r[4] for r in whole] == [r[1] for r in sorted(map(tuple, rows.collect()))]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count(", 41)") >= 2
