"""What the operators share: the shared folder, tables that cut lineage, and ranks without a single task."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Only for sessions on one machine without spark.checkpoint.dir, that is in tests.
LOCAL_SHARED = "file:///tmp/confab-shared"
#: Hexadecimal digits of a rank's bucket; 16^3 buckets a group keep windows short whatever the group's size.
BUCKET_DIGITS = 3


#: Bytes of a batch that goes to Python: long texts make batches of few rows, and a worker's memory doesn't follow the rows' sizes.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Gives this session's executors the package, once; they may start elsewhere than in its folder. Batches for Python are held to BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_confab_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()  # the driver serves the file from there as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "confab_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._confab_shipped = True


def shipped(f: Callable) -> Callable:
    """``f(spark, ...)`` after ``ship(spark)``."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Off one machine there is no default: executors couldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or LOCAL_SHARED).rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's Python ends."""
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/confab-{context.applicationId}"
    if getattr(context, "_confab_folder", None) != path:
        context._confab_folder = path
        atexit.register(_released, spark, path)
    return path


def _released(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        removed(spark, path)


class Scratch:
    """Tables of one operator's run in the shared folder; those that no result reads any more can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` written to a table of its own and read back: later jobs don't repeat its work, and a lost executor costs no more than its running tasks."""
        path = f"{own_folder(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                removed(self.spark, path)

    def keep_only(self, *tables: DataFrame) -> None:
        kept = {id(t) for t in tables}
        self.drop(*(t for t, _ in list(self.paths.values()) if id(t) not in kept))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote, through the file system it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table that stays for the result's sake."""
    return Scratch(df.sparkSession).table(df, tag)


def free_names(df: DataFrame, *wishes: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each wish."""
    taken, out = {c.lower() for c in df.columns}, []
    for wish in wishes:
        while wish.lower() in taken:
            wish = f"_{wish}"
        taken.add(wish.lower())
        out.append(wish)
    return out


def text_key(text: Column) -> Column:
    """128 bits of a text as one hexadecimal text; null and empty pass for equal."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def trimmed() -> None:
    """Gives what this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, after which the worker gives its memory back: it outlives the task, and idles beside stages that don't need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trimmed()

    return run


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` as a table, by way of Arrow: createDataFrame of a list runs Python workers on the executors, under a daemon of their own that stays."""
    struct = StructType.fromDDL(schema)
    kinds = to_arrow_schema(struct)
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds), struct)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def rank_key(*cols: Column) -> Column:
    """A text that orders rows pseudorandomly and alike on every run; nulls count as empty."""
    return F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def running(df: DataFrame, group: str, key: str, ties: list[str], weight: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows of the same group that precede in the order of (key, *ties).

    ``key`` holds a rank_key. Each group is cut into buckets by the key's first digits: sums of the buckets (one small
    row each, map-side combined) give every bucket's offset, windows within the buckets the rest, so that no task
    sees a whole group as long as its keys differ: rows of one key share a bucket. Null groups are a group.
    """
    bucket, own, total, g, b, base, inner = free_names(df, "_bucket", "_own", "_sum", "_g", "_b", "_base", "_in")
    cut = df.withColumn(bucket, F.substring(key, 1, BUCKET_DIGITS)).withColumn(own, weight.cast("bigint"))
    sums = cut.groupBy(group, bucket).agg(F.sum(own).alias(total))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias(g), F.col(bucket).alias(b), F.coalesce(F.sum(total).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(group, bucket).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn(inner, F.coalesce(F.sum(own).over(within), F.lit(0)))
    joined = ranked.join(offsets, F.col(group).eqNullSafe(F.col(g)) & (F.col(bucket) == F.col(b)))
    return joined.withColumn(name, F.col(inner) + F.col(base)).drop(bucket, base, own, inner, g, b)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a partition that is sorted by them, one table each; holds a batch and one group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, batch.num_rows]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            key = tuple(cols[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
