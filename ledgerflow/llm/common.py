"""What the corpus operators share: the shared folder, staged tables and the text conventions."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Deleting these six characters deletes the class [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"
#: One word; possessive, so that a long word needs no backtracking.
WORD = r"[^\x20\x09-\x0D]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir.get(spark.sparkContext.applicationId) is None:
        own = tempfile.mkdtemp(prefix="ledgerflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dir[spark.sparkContext.applicationId] = f"file://{own}"
    return _own_dir[spark.sparkContext.applicationId]


_own_dir: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is staged: texts may be long, and a batch stands in memory on both sides.
BATCH, _BATCH_CONF = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: it cuts the lineage and survives lost executors."""
    path, conf = work_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_BATCH_CONF)
    conf.set(_BATCH_CONF, str(BATCH))
    try:
        df.write.parquet(path)
    finally:
        conf.set(_BATCH_CONF, before)
    if _made:
        _made[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: list[list[str]] = []


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives keep(df, name), which stages what shall stay; all other tables staged inside are removed at its end."""
    _made.append([])
    kept = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        kept.append(_made[-1].pop())
        return out

    try:
        yield keep
    finally:
        for path in _made.pop():
            removed(spark, path)
        if _made:
            _made[-1].extend(kept)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove this application's staged tables; for long-lived sessions, once their results are written."""
    removed(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def tidy() -> None:
    """Give back what a Python worker has freed; for the end of a task, since workers outlive their tasks and keep what they once took."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with the sum of a column over the rows before each in a total order, by sums {out: column}.

    Rows are dealt by ranges of the order; sums inside a range get those of the ranges before, one row a range. No task sees all rows.
    """
    part = staged(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = part.groupBy("__part").agg(*[F.sum(c).alias(f"__{out}") for out, c in sums.items()])
    before = totals.select("__part", *[F.coalesce(F.sum(f"__{out}").over(ahead), F.lit(0)).alias(f"__{out}") for out in sums])
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = part.withColumns({out: F.coalesce(F.sum(c).over(inside), F.lit(0)) for out, c in sums.items()}).join(before, "__part")
    return found.withColumns({out: F.col(out) + F.col(f"__{out}") for out in sums}).drop("__part", *[f"__{out}" for out in sums])


def whole_text(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_hash(text_col: str = "text") -> Column:
    """Tells rows of one id, or of none, apart by their texts."""
    return F.xxhash64(F.col(text_col))


#: Bits of a sieve: this many for each key, between two bounds; the upper one is a broadcast of 16 MB.
SIEVE_BITS, SIEVE_LEAST, SIEVE_MOST = 16, 1 << 20, 1 << 27


def _probed(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with __seen: whether the key may stand in keys (a table with one column), by a bitmap of bounded size that meets the rows before any shuffle."""
    n, bits = keys.count(), SIEVE_LEAST
    while bits < min(SIEVE_BITS * n, SIEVE_MOST):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = place(keys.columns[0])
    bitmap = keys.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    found = rows.withColumn("__place", place(key)).withColumn("__bucket", F.bitmap_bucket_number("__place"))
    found = found.join(F.broadcast(bitmap), "__bucket", "left")  # SIEVE_MOST / 32768 rows of 4 KB at most
    bit = F.bitmap_bit_position("__place")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return found.withColumn("__seen", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)))


def sieve(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may stand in keys, and few others.

    Beyond SIEVE_MOST / SIEVE_BITS keys more and more other rows pass, so what follows still joins with the keys.
    """
    return _probed(rows, key, keys).where("__seen").select(*rows.columns)


def sifted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that sieve() lets pass, and the rows whose key certainly doesn't stand in keys."""
    probed = _probed(rows, key, keys)
    return tuple(probed.where(c).select(*rows.columns) for c in ("__seen", "NOT __seen"))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row of docs as one struct `row`, beside columns of ours: so no column of docs can clash with them. select("row.*") unpacks."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def without_rows(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose (id, row_hash) pairs names with drop, and with one row of each pair that it names without; the columns of docs.

    pairs: distinct (doc_id, row_hash, drop), all pairs with several rows among them; null ids match null. Rows that pairs doesn't name pass the
    sieve's complement and are never shuffled. Rows of one pair become one ahead of the join, in each task first. An empty
    table stays empty; columns of docs may have any names.
    """
    pairs = staged(pairs.select("doc_id", "row_hash", "drop", F.xxhash64("doc_id", "row_hash").alias("pair")), "pairs")
    rows = packed(docs, F.col(id_col).alias("doc_id"), row_hash(text_col).alias("row_hash")).withColumn("pair", F.xxhash64("doc_id", "row_hash"))
    named, others = sifted(rows, "pair", pairs.select("pair"))
    named = named.dropDuplicates(["pair", "doc_id", "row_hash"])
    gone = pairs.where("drop").select(F.col("pair").alias("gone"), F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_hash"))
    stay = named.join(gone, (F.col("pair") == F.col("gone")) & (F.col("row_hash") == F.col("gone_hash")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    return others.select("row.*").unionByName(stay.select("row.*"))
