import bz2
import gzip
import io
import lzma
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from cfgveil.operators import archives as arc

FILES = {"a/running.cfg": b"enable secret 5 X\r\n", "a/b/notes.bin": bytes(range(256)), "readme.md": b"hi"}


def zipped(files=FILES, folder="a/"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(folder, b"")
        for n, b in files.items():
            z.writestr(n, b)
    return out.getvalue()


def tarred(mode, files=FILES):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        t.addfile(tarfile.TarInfo("link"))
        folder = tarfile.TarInfo("a")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for n, b in files.items():
            info = tarfile.TarInfo(n)
            info.size = len(b)
            t.addfile(info, io.BytesIO(b))
    return out.getvalue()


def locked_zip():
    data = bytearray(zipped({"s.txt": b"secret"}))
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        i = data.rfind(mark)
        data[i + at] |= 1
    return bytes(data)


@pytest.fixture
def archives(spark):
    rows = {
        "/z/one.ZIP": zipped(), "/z/two.tar": tarred("w"), "/z/three.tgz": tarred("w:gz"), "/z/four.tar.bz2": tarred("w:bz2"),
        "/z/five.txz": tarred("w:xz"), "/z/c.cfg.gz": gzip.compress(b"text\n"), "/z/d.cfg.bz2": bz2.compress(b"text\n"),
        "/z/e.cfg.xz": lzma.compress(b"text\n"), "/z/nosuffix": zipped(), "/z/tarball": tarred("w"), "/z/f.rar": b"Rar!\x1a\x07\x00",
        "/z/g.7z": b"7z", "/z/h.zip": b"not a zip", "/z/i.dat": b"nothing", "/z/j.zip": locked_zip(), "/z/k": gzip.compress(b"x"),
        "/z/l": bz2.compress(b"x"), "/z/m": lzma.compress(b"x"), "/z/n": b"7z\xbc\xaf\x27\x1c00", "/z/o": b"Rar!\x1a\x07\x00", "/z/p": b"",
    }
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "path string, content binary")


def test_types(archives):
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in archives.select("path", arc.archive_type(F.col("path"), F.col("content")).alias("kind")).collect()}
    assert got == {
        "one.ZIP": "zip", "two.tar": "tar", "three.tgz": "tar", "four.tar.bz2": "tar", "five.txz": "tar", "c.cfg.gz": "gzip",
        "d.cfg.bz2": "bzip2", "e.cfg.xz": "xz", "nosuffix": "zip", "tarball": "tar", "f.rar": "rar", "g.7z": "7zip", "h.zip": "zip",
        "i.dat": None, "j.zip": "zip", "k": "gzip", "l": "bzip2", "m": "xz", "n": "7zip", "o": "rar", "p": None,
    }


def test_expand(archives):
    rows = arc.expand_archives(archives).collect()
    by = {}
    for r in rows:
        by.setdefault(r.archive.rsplit("/", 1)[1], {})[r.member] = r
    for name in ("one.ZIP", "nosuffix"):
        assert {m: bytes(r.content) for m, r in by[name].items()} == FILES
    for name in ("two.tar", "three.tgz", "four.tar.bz2", "five.txz", "tarball"):
        assert {m: bytes(r.content) for m, r in by[name].items()} == {**FILES, "link": b""}
    for name, member in (("c.cfg.gz", "c.cfg"), ("d.cfg.bz2", "d.cfg"), ("e.cfg.xz", "e.cfg")):
        assert bytes(by[name][member].content) == b"text\n" and by[name][member].size == 5
    assert by["f.rar"][None].error == "Extraction not supported for rar"
    assert by["g.7z"][None].error == "Extraction not supported for 7zip"
    assert by["h.zip"][None].error.startswith("Failed to extract archive")
    assert by["i.dat"][None].error == by["p"][None].error == "Unsupported archive format"
    assert by["j.zip"]["s.txt"].error == "encrypted member" and by["j.zip"]["s.txt"].encrypted
    assert len(by) == 21


def test_oversized_archives_are_error_rows(archives):
    rows = arc.expand_archives(archives.filter("path like '%one.ZIP'"), max_bytes=10).collect()
    assert [r.error for r in rows] == ["Archive exceeds the size limit of one cell"]


def test_info_and_errors(archives):
    members = arc.expand_archives(archives.filter("path like '%one.ZIP' or path like '%j.zip' or path like '%f.rar'"))
    info = {r.archive.rsplit("/", 1)[1]: r for r in arc.archive_info(members).collect()}
    assert (info["one.ZIP"].total_files, info["one.ZIP"].config_files, info["one.ZIP"].encrypted) == (3, 1, False)
    assert (info["j.zip"].total_files, info["j.zip"].encrypted) == (1, True)
    assert info["f.rar"].total_files == 0
    errors = sorted(r.error for r in arc.archive_errors(members).collect())
    assert errors == ["f.rar: Extraction not supported for rar", "s.txt: encrypted member"]


@pytest.mark.parametrize("fmt", arc.ARCHIVE_FORMATS)
def test_repack_roundtrip(spark, fmt):
    rows = [("x", f"d/f{i}.cfg", bytearray(f"text {i}".encode())) for i in range(20)]
    members = spark.createDataFrame(rows, "archive string, member string, content binary")
    packed = arc.repack_archives(members, fmt).select(F.concat("archive", F.lit(f".{fmt}")).alias("path"), "content")
    assert sorted((r.member, bytes(r.content)) for r in arc.expand_archives(packed).collect()) == sorted((m, bytes(b)) for _, m, b in rows)


def test_volumes_hold_every_member_once(spark):
    rows = [("big" if i % 3 else "small", f"f{i}", bytearray(bytes([i % 251]) * (1000 if i % 3 else 5))) for i in range(300)]
    members = spark.createDataFrame(rows, "archive string, member string, content binary")
    packed = arc.repack_archives(members, "tar", volume_bytes=20_000).cache()
    shape = {(r.archive, r.volume): r for r in packed.collect()}
    assert sum(a == "small" for a, _ in shape) == 1
    assert sum(a == "big" for a, _ in shape) >= 10  # of as many stretches
    opened = arc.expand_archives(packed.select(F.concat_ws("", "archive", F.lit(".tar")).alias("path"), "content"))
    assert sorted((r.archive[:-4], r.member) for r in opened.collect()) == sorted((a, m) for a, m, _ in rows)


def test_flattened_names_clash_but_stay(spark):
    rows = [("x", "a/f.cfg", bytearray(b"1")), ("x", "b/f.cfg", bytearray(b"2")), ("x", "c/g.cfg", bytearray(b"3"))]
    members = spark.createDataFrame(rows, "archive string, member string, content binary")
    packed = arc.repack_archives(members, "tar", preserve_structure=False).select(F.lit("x.tar").alias("path"), "content")
    assert sorted(r.member for r in arc.expand_archives(packed).collect()) == ["f.cfg", "f.cfg", "g.cfg"]
    assert [tuple(r) for r in arc.name_clashes(members).collect()] == [("x", "f.cfg", 2)]


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="Unsupported archive format"):
        arc.repack_archives(spark.createDataFrame([], "archive string, member string, content binary"), "rar")


def test_sanitizing_members(archives):
    done = arc.sanitize_members(arc.expand_archives(archives.filter("path like '%one.ZIP' or path like '%f.rar'")))
    got = {r.member: (bytes(r.output) if r.output is not None else None, r.modified) for r in done.collect()}
    assert got == {
        "a/running.cfg": (b"enable secret 5 <removed-enable-secret>\r\n", True), "a/b/notes.bin": (bytes(range(256)), False),
        "readme.md": (b"hi", False), None: (None, False),
    }
    result = {r.archive.rsplit("/", 1)[1]: (r.extracted_files, r.sanitized_files, r.errors) for r in arc.archive_result(done).collect()}
    assert result == {"one.ZIP": (3, 1, 0), "f.rar": (0, 0, 1)}


def test_config_file_names(spark):
    names = {"a.txt": True, "a.TXT": False, "x/show run": True, "backup/CONFIGS/x.bin": True, "a.log": False, "a.Config": True, "a.xml": True, "startup.gz": True, "a.pdf": False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.c for r in df.select("n", arc.is_config_file(F.col("n")).alias("c")).collect()} == names


def test_preview(spark):
    members = spark.createDataFrame([(a, f"m{i:03}") for a in "xy" for i in range(30)], "archive string, member string")
    rows = arc.member_preview(members, 3).orderBy("archive", "position").collect()
    assert [(r.archive, r.member, r.position) for r in rows] == [(a, f"m{i:03}", i + 1) for a in "xy" for i in range(3)]


def test_worker_functions_need_no_installed_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((arc._expand, arc._pack)))
    (tmp_path / "z.zip").write_bytes(zipped())
    code = (
        "import pickle, pandas as pd\n"
        "expand, pack = pickle.load(open('f.pkl', 'rb'))\n"
        "batch = pd.DataFrame({'path': ['z.zip'], 'kind': ['zip'], 'refused': [None], 'content': [open('z.zip', 'rb').read()]})\n"
        "members = pd.concat(expand(iter([batch])))\n"
        "print(len(members), len(pack('tar.gz', members)) > 0)\n"
    )
    # -I keeps the working folder and PYTHONPATH out; the package cannot be imported.
    done = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["3", "True"]


def test_volumes_are_bounded(spark):
    """Every member once; a volume holds `volume_bytes` and one member at most, and small archives stay whole."""
    rnd = random.Random(5)
    sizes = {f"m{k:03d}": rnd.choice([0, 10, 400, 900, 5000]) for k in range(120)}
    rows = [("big", m, bytes(n), n) for m, n in sizes.items()] + [("small", "a", b"x" * 50, 50), ("small", "b", b"", 0)]
    df = spark.createDataFrame(rows, "archive string, member string, content binary, size bigint").repartition(4)
    packed = arc.repack_archives(df, "zip", volume_bytes=2000).collect()
    found = {(p.archive, p.volume): {i.filename: i.file_size for i in zipfile.ZipFile(io.BytesIO(p.content)).infolist()} for p in packed}
    big = sorted(v for a, v in found if a == "big")
    assert big == list(range(1, len(big) + 1)) and {p.volumes for p in packed if p.archive == "big"} == {len(big)}
    assert {m: n for (a, _), x in found.items() if a == "big" for m, n in x.items()} == sizes and found["small", 1] == {"a": 50, "b": 0}
    assert all(sum(x.values()) - max(x.values()) <= 2000 and len(x) > 0 for x in found.values())
    assert arc.repack_archives(df.limit(0), "zip").collect() == []
