"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, where only oversized buckets split.

Bytes add up by the DEPTH first bits of a row's hash, once; coarser prefixes add up from these. A bucket is the shortest prefix whose
bytes fit the limit, so a directory of depth d holds buckets of fewer bits where nothing is oversized. Rows meet the
directory by prefix in a join; the directory never goes to the driver.

A row larger than the limit has a shard alone. Rows that share all DEPTH bits and exceed the limit together, as
repeated rows do, are dealt on by their order: their running bytes, counted in each task and then over the tasks, fill further shards.

Defined cases: a null text has 0 bytes; a null id is hashed as an empty one; an empty table gives an empty result; the
columns of the table are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed, staged, table, whole_text

#: Bytes that a shard holds at most, and the bits of a prefix at most.
LIMIT, DEPTH = 1 << 20, 48


def prefix_hash(id_col: Column) -> Column:
    """The first 48 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def _name(depth: Column, prefix: Column) -> Column:
    """The bits of a prefix; the bucket of depth 0 is named root."""
    return F.when(depth == 0, "root").otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0"))


def directory(sized: DataFrame, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """(depth, prefix, bytes, rows) of the buckets, from rows (h, bytes).

    A level looks at the buckets that the level before left oversized, so levels stop as soon as all fit.
    """
    left = staged(sized.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "hashes")
    done = None
    for d in range(depth + 1):
        bucket = F.shiftright("h", DEPTH - d) if d else F.lit(0).cast("long")
        sums = left.groupBy(bucket.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        sums = staged(sums.select(F.lit(d).alias("depth"), "prefix", "bytes", "rows"), "level")
        over = (F.col("bytes") > limit) & (F.col("rows") > 1) & (F.col("depth") < depth)
        done = sums.where(~over) if done is None else done.unionByName(sums.where(~over))
        if sums.where(over).isEmpty():
            break
        left = left.withColumn("prefix", bucket).join(sums.where(over).select("prefix"), "prefix", "left_semi").drop("prefix")
        left = staged(left, "hashes") if d % 4 == 3 else left
    return staged(done, "directory")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, depth: int = DEPTH, row_col: str | None = None) -> DataFrame:
    """(doc_id, bytes, shard, shard_bytes) per row of docs, and row_col where it is given."""
    kept = ["doc_id", "bytes"] + ([row_col] if row_col else [])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(whole_text(text_col)).cast("long").alias("bytes"), *kept[2:])
    rows = staged(rows.withColumn("h", prefix_hash(F.col("doc_id"))).withColumn("task", F.spark_partition_id()), "rows")
    buckets = directory(rows, limit, depth)
    depths = [r["depth"] for r in buckets.select("depth").distinct().orderBy("depth").collect()]  # depth + 1 values at most
    placed = rows.withColumn("probe", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), (F.shiftright("h", DEPTH - d) if d else F.lit(0).cast("long")).alias("prefix")) for d in depths])) if depths else F.lit(None).cast("struct<depth:int,prefix:bigint>"))
    placed = placed.select(*kept, "h", "task", "probe.*").join(buckets.withColumnRenamed("bytes", "bucket_bytes"), ["depth", "prefix"])
    name = _name(F.col("depth"), F.col("prefix"))
    over = (F.col("bucket_bytes") > limit) & (F.col("rows") > 1)
    fits = placed.where(~over).select(*kept, name.alias("shard"), F.col("bucket_bytes").alias("shard_bytes"))
    same = placed.where(over).withColumn("shard", name)
    if buckets.where((F.col("bytes") > limit) & (F.col("rows") > 1)).isEmpty():
        return fits
    by_task = same.groupBy("shard", "task").agg(F.sum("bytes").alias("task_bytes"))
    before = by_task.withColumn("before", F.coalesce(F.sum("task_bytes").over(W.partitionBy("shard").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    in_task = F.sum("bytes").over(W.partitionBy("shard", "task").orderBy("bytes", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    dealt = same.withColumn("upto", in_task).join(before.select("shard", "task", "before"), ["shard", "task"])
    # each further shard takes half a limit of running bytes, so that a row over its edge still fits
    dealt = staged(dealt.select(*kept, F.concat_ws("-", "shard", F.floor((F.col("before") + F.col("upto") - F.col("bytes")) / F.lit(max(1, limit // 2)))).alias("shard")), "dealt")
    alone = F.when(F.col("bytes") > limit // 2, F.concat_ws("-", "shard", F.lit("alone"), F.monotonically_increasing_id())).otherwise(F.col("shard"))
    dealt = staged(dealt.withColumn("shard", alone), "dealt")
    sizes = dealt.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return fits.unionByName(dealt.join(sizes, "shard").select(*kept, "shard", "shard_bytes"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", limit: int = LIMIT, text_col: str = "text", folder: str = "shard") -> str:
    """docs as Parquet, one folder for each shard; returns the name of the folders' column.

    Rows get a number and are staged with it, so that each goes to its own shard also where ids repeat or are null. All columns are kept, whatever
    their names: where one is called like the folders, these get underscores.
    """
    while folder.lower() in {c.lower() for c in docs.columns}:
        folder += "_"
    numbered = staged(packed(docs, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("number")), "numbered")
    own = shards(numbered, limit=limit, row_col="number").select("number", "shard")
    placed = numbered.select("row", "number").join(own, "number").repartition("shard")
    placed.select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
    return folder


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS h FROM documents),
lv AS (SELECT range AS depth FROM range(0, 49)),
s AS (SELECT depth, h >> CAST(48 - depth AS INT) AS prefix, sum(bytes) AS bytes, count(*) AS n FROM d, lv GROUP BY ALL),
f AS (SELECT d.doc_id, d.bytes, min(s.depth) AS depth FROM d, s WHERE s.prefix = d.h >> CAST(48 - s.depth AS INT) AND (s.bytes <= 1048576 OR s.n = 1 OR s.depth = 48) GROUP BY ALL)
SELECT f.doc_id, f.bytes, CASE WHEN f.depth = 0 THEN 'root' ELSE right('000000000000000000000000000000000000000000000000' || CAST(bin(s.prefix) AS VARCHAR), CAST(f.depth AS INT)) END AS shard, CAST(s.bytes AS BIGINT) AS shard_bytes
FROM f JOIN d ON f.doc_id = d.doc_id JOIN s ON s.depth = f.depth AND s.prefix = d.h >> CAST(48 - f.depth AS INT)
"""
