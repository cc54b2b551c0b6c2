"""Folders listed and files written by the executors, through Arrow's file systems.

Arrow reaches local and mounted folders, S3 and GCS, and HDFS where its library is installed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cfgveil.session import materialized

# The functions below travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRY = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64())])
ENTRIES_AT_ONCE = 10_000
BODY_BYTES = 32 << 20
# A task reads up to so many files, or so many bytes of them.
FILES_PER_TASK, BYTES_PER_TASK = 16_384, 64 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's scans give paths."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a qualified path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def reachable(spark: SparkSession, root: str) -> bool:
    """Can Arrow open this folder? Globs and other stores are left to Spark's own listing."""
    if any(c in root for c in "*?[{"):
        return False
    try:
        open_store(qualified(spark, root))
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


def hidden(name: str) -> bool:
    """Names that Spark's scans pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each folder of `path`, hidden ones left out; a folder that has gone has none."""
    names, folders, sizes = [], [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64())], schema=ENTRY)

    for given in batches:
        for folder in given.column("path").to_pylist():
            for path, is_folder, size in _inside(folder):
                names.append(path)
                folders.append(is_folder)
                sizes.append(size)
                if len(names) >= ENTRIES_AT_ONCE:  # many small folders share a batch, a large one fills several
                    yield batch()
                    names, folders, sizes = [], [], []
    if names:
        yield batch()


def _inside(folder: str) -> Iterator[tuple[str, bool, int | None]]:
    """(path, is a folder, length) of the entries of one folder, hidden ones left out; a folder that has gone has none."""
    store, inside = open_store(folder)
    for f in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
        if not hidden(f.base_name) and f.type in (fs.FileType.File, fs.FileType.Directory):
            yield f"{folder.rstrip('/')}/{f.base_name}", f.type == fs.FileType.Directory, f.size if f.type == fs.FileType.File else None


def _below(dealing: bool):
    """Rows (path, folder, length): files as they are, folders replaced by the files below them.

    `dealing`: only down to where a folder branches; the folders there stay as rows, to be dealt out.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.type) for k, kind in enumerate(ENTRY)], schema=ENTRY)

        for given in batches:
            for path, folder, length in zip(*(given.column(k).to_pylist() for k in range(3)), strict=True):
                pending = [path] if folder else []
                rows += [] if folder else [(path, folder, length)]
                while pending and not (dealing and len(pending) > 1):
                    for entry in _inside(pending.pop()):
                        if entry[1]:
                            pending.append(entry[0])
                        else:
                            rows.append(entry)
                        if len(rows) >= ENTRIES_AT_ONCE:
                            yield batch(rows)
                            rows = []
                rows += [(p, True, None) for p in pending]
                if len(rows) >= ENTRIES_AT_ONCE:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return walk


def arriving_files(spark: SparkSession, root: str, names: str) -> DataFrame:
    """(path, length) of the files below one folder whose names match a Java pattern, as a stream: each path once.

    A trigger is one tick, on which the executors list the folder: one task down to where it branches, others these
    branches, dealt out twice. Which paths were met before is Spark's
    deduplication, in keyed state on the executors. Nothing of a file passes the driver. A batch that runs again after a
    failure lists again: its rows must replace those of the first attempt, as the `run_` functions' do.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", "1").option("numPartitions", "1").load()
    entry = "path string, folder boolean, length bigint"
    top = ticks.select(F.lit(qualified(spark, root)).alias("path"), F.lit(True).alias("folder"), F.lit(None).cast("bigint").alias("length"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    branches = top.mapInArrow(_below(True), entry).repartition(tasks).mapInArrow(_below(True), entry).repartition(tasks)
    files = branches.mapInArrow(_below(False), entry).select("path", "length")
    return files.where(F.element_at(F.split("path", "/"), -1).rlike(names)).dropDuplicates(["path"])


def list_folder(spark: SparkSession, root: str, *, recursive: bool = True) -> DataFrame:
    """(path, length) of every file below `root`, those of length zero included.

    One job a level: the folders of a level are dealt over the executors, and what they hold
    is written as a table, so no path passes the driver. A folder is listed by one task.
    """
    level = spark.createDataFrame([(qualified(spark, root),)], "path string")
    found = None
    while True:
        # Every partition of a folder table may hold many folders of very unequal size.
        dealt = level.repartition(4 * spark.sparkContext.defaultParallelism)
        entries = materialized(dealt.mapInArrow(_entries, "path string, folder boolean, length bigint"), "listing")
        files = entries.where("not folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = entries.where("folder").select("path")
        if not recursive or level.isEmpty():
            return found


def is_folder(spark: SparkSession, root: str) -> bool:
    """Is this one folder that the executors can list?"""
    if not reachable(spark, root):
        return False
    where = spark._jvm.org.apache.hadoop.fs.Path(qualified(spark, root))
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(where) and store.getFileStatus(where).isDirectory()


def _read(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = open_store(root)
        paths, bodies, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])

        for given in batches:
            for path, wanted in zip(given.column("path").to_pylist(), given.column("wanted").to_pylist(), strict=True):
                body = None
                if wanted:
                    with store.open_input_file(inside.rstrip("/") + path.removeprefix(root.rstrip("/"))) as file:
                        body = file.read()
                if paths and held + len(body or b"") > BODY_BYTES or len(paths) >= ENTRIES_AT_ONCE:
                    yield batch()
                    paths, bodies, held = [], [], 0
                paths.append(path)
                bodies.append(body)
                held += len(body or b"")
        if paths:
            yield batch()

    return read


def read_bodies(files: DataFrame, root: str, limit: int) -> DataFrame:
    """(path, content) of the files (path, length) below `root`, read by the executors; null above `limit` bytes, unopened.

    Files leave a worker in batches of bounded size, one file at least. The rows may be a stream.
    """
    wanted = files.select("path", (F.col("length") <= limit).alias("wanted"))
    return wanted.mapInArrow(_read(qualified(files.sparkSession, root)), "path string, content binary")


def dealt_files(files: DataFrame) -> DataFrame:
    """The files (path, length) of a written table, dealt over as many tasks as their number and bytes ask for."""
    size = files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).first()
    tasks = max(-(-size["files"] // FILES_PER_TASK), -(-(size["bytes"] or 0) // BYTES_PER_TASK))
    return files.repartition(max(tasks, files.sparkSession.sparkContext.defaultParallelism))


def _written(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, inside = open_store(root)
        own = f"{inside.rstrip('/')}/.{uuid.uuid4().hex}"  # tasks that make files in one folder would wait for each other
        made = set()
        try:
            for batch in batches:
                rows = []
                for name, body in zip(batch.column("name").to_pylist(), batch.column("body"), strict=True):
                    path = f"{inside.rstrip('/')}/{name}"
                    data = body.as_buffer() if body.is_valid else b""
                    folder = path.rpartition("/")[0]
                    for needed in {own, folder} - made:
                        store.create_dir(needed, recursive=True)
                        made.add(needed)
                    with store.open_output_stream(f"{own}/part") as out:
                        out.write(data)
                    store.move(f"{own}/part", path)  # a repeated task replaces whole files
                    rows.append((f"{root.rstrip('/')}/{name}", len(data)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "length"])
        finally:
            if own in made:
                store.delete_dir(own)

    return write


def write_bodies(df: DataFrame, root: str) -> DataFrame:
    """Write every row (name, body binary) as a file of its own below `root`; (path, length) of what was written.

    Names may hold folders. Of rows with one name, one stays. The files are written when this is
    called, by the executors; a task that runs again replaces its files.
    """
    spark = df.sparkSession
    where = qualified(spark, root)
    if not reachable(spark, root):
        raise ValueError(f"files can't be written one by one to {where}")
    return materialized(df.select("name", "body").mapInArrow(_written(where), "path string, length bigint"), "written")
