"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset and the master is local (tests), a temporary folder is made and set as the checkpoint folder. On a
    cluster a temporary folder of one machine would lose what the others write, so an unset folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Sends the package to executors that would not find it where the driver does."""
    root = Path(__file__).resolve().parents[2]
    found = {os.path.abspath(p) for p in (os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))}
    sc = spark.sparkContext
    if str(root) in found or not root.is_dir() or getattr(sc, "_quern_shipped", False):
        return
    path = f"{tempfile.mkdtemp(prefix='quern-')}/quern.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "quern").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(path)
    sc._quern_shipped = True


def shipped(query):
    """A query (its first argument the session) that ships the package first."""

    @functools.wraps(query)
    def run(spark, *args, **settings):
        ship(spark)
        return query(spark, *args, **settings)

    return run


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Spark deletes the shuffle files of an action in here as soon as it ends, rather than when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Paths of the tables that are made in the innermost owned() block.
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned():
    """Lists the tables that written() makes in the block, and nobody else's; whoever opens it may delete them."""
    mine: list[str] = []
    token = _OWNER.set(mine)
    try:
        yield mine
    finally:
        _OWNER.reset(token)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, keeps one copy of the work.

    The table goes with discard(), with its owner (see owned()), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern/{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("compression", codec).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if (mine := _OWNER.get()) is not None:
        mine.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quern_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and that nothing needs any more."""
    for table in tables:
        delete(table.sparkSession, table._quern_path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def trim() -> None:
    """Gives memory that a finished step of a Python worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def plain(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs as c0, c1, ..., doc_id (long) and text (string), so that no name can clash; the names of c0, c1, ..."""
    others = [c for c in docs.columns if c != text_col]
    return docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), others


def named(rows: DataFrame, others: list[str], like: DataFrame, text_col: str, *more: str) -> DataFrame:
    """The columns of `like` again, from rows of plain(), and further ones."""
    at = {c: f"c{k}" for k, c in enumerate(others)}
    return rows.select(*[F.col("text" if c == text_col else at[c]).alias(c) for c in like.columns], *more)


def small_batches(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of an Arrow batch with about `limit` bytes of `column` each, a row at least."""
    sizes = np.cumsum(byte_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each string of an Arrow column; null counts as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each of the ranges, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def by_key(df: DataFrame, rows: int, *key: str, per: int = 2_000_000) -> DataFrame:
    """df dealt by a key to the session's number of partitions, or to more if they would get over `per` rows each."""
    least, parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per)
    return df.repartition(min(parts, 1 << 17), *key) if parts > least else df.repartition(*key)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b), both long: rows (node, root), root the smallest node reachable.

    Every round each node takes the smallest root among its neighbours' and then its root's own root, so
    long chains close in a logarithmic number of rounds. The label table is written each round and that before it deleted;
    nothing but a count of changes comes to the driver. Joins are plain equi-joins, which AQE can split on hot nodes.
    """
    spark = links.sparkSession
    both = written(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(None).cast("long").alias("old")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.select("node", "root").join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = written(step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"))
        discard(labels)
        labels = new
        with cleaned(spark):
            changed = labels.where("old <> root").limit(1).count()
        if not changed:
            discard(both)
            return labels.select("node", "root")
    raise RuntimeError("components did not settle")
