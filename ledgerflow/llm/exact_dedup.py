"""Exact deduplication: 128-bit content hashes, confirmed by comparing bytes inside each group.

Rows group by the MD5 of the text without white space; counts and survivors are aggregates, which each task computes for its own rows first.
Groups of one row are done. For the others a sieve over their hashes lets the texts pass, and the least and the greatest
bytes of a group, aggregates again, are compared: where they are equal, all texts of the group are. So no text of a
single row is shuffled, and a group of any size is one text for each task. Groups with a collision are grouped anew by their bytes.

Defined cases: a null text is an empty one, and all empty texts are equal; a null id is a document of its own kind that
survives only where its group has no row with an id and the same length; rows that repeat an id and a text count each
and share one decision; texts of any length are read whole; an empty table gives an empty result; further columns are not looked at, and kept by exact_dedup().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, row_hash, sieve, sifted, staged, table, whole_text, without_rows


def normalised(text: Column) -> Column:
    return F.translate(text, WHITESPACE, "")


def _sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """group_size and the row that stays, by keys; bitwise not turns the order of ids round without overflow."""
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("turned"), "row_hash"))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    return groups.select(*keys, "group_size", F.bitwise_not("best.turned").alias("keep_id"), F.col("best.row_hash").alias("keep_hash"))


def _decided(rows: DataFrame) -> DataFrame:
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "row_hash", "keep_id", "group_size", kept.alias("kept"), (kept & (F.col("row_hash") == F.col("keep_hash"))).alias("stays"), "text_sha256")


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), row_hash(text_col).alias("row_hash"), whole_text(text_col).alias("text")).withColumn("norm", normalised(F.col("text"))).withColumn("h", content_hash(F.col("norm")))
    marks = staged(texts.select("doc_id", "row_hash", F.length("text").alias("n"), "h", F.sha2("norm", 256).alias("text_sha256")), "marks")
    groups = staged(_sizes(marks, "h").where("group_size > 1"), "groups")
    bytes_ = F.col("norm").cast("binary")
    met = sieve(texts.select("doc_id", "row_hash", "h", "norm"), "h", groups.select("h"))
    collided = staged(met.groupBy("h").agg(F.min(bytes_).alias("least"), F.max(bytes_).alias("most")).where("least <> most").select("h"), "collisions")
    several, single = sifted(marks, "h", groups.select("h"))
    alone = single.withColumns({"group_size": F.lit(1).cast("long"), "keep_id": F.col("doc_id"), "keep_hash": F.col("row_hash")})
    if collided.isEmpty():
        joined = several.join(groups, "h", "left")
    else:
        joined = several.join(groups.join(collided, "h", "left_anti"), "h", "left").join(collided, "h", "left_anti")
        own = met.join(collided, "h").select("h", F.col("doc_id").alias("own_id"), F.col("row_hash").alias("own_hash"), "norm").distinct()
        apart = marks.join(collided, "h").join(own, "h").where(F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row_hash") == F.col("own_hash"))).drop("own_id", "own_hash")
        apart = staged(apart, "apart")
        alone = alone.unionByName(apart.join(staged(_sizes(apart, "h", "norm"), "groups"), ["h", "norm"]).select(*alone.columns))
    # a hash that the sieve let pass by chance has no group
    joined = joined.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "keep_hash": F.coalesce("keep_hash", "row_hash"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return _decided(joined.select(*alone.columns).unionByName(alone))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of docs.

    The row that stays is the one with the most code points, then the smallest id.
    """
    return _grouped(docs, id_col, text_col, content_hash).drop("row_hash", "stays")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with the columns of docs."""
    rows = _grouped(docs, id_col, text_col).where("group_size > 1").groupBy("doc_id", "row_hash").agg(F.max("stays").alias("stays"))
    return without_rows(docs, rows.select("doc_id", "row_hash", (~F.col("stays")).alias("drop")), id_col, text_col)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS group_size, max(n) AS n FROM d GROUP BY t),
k AS (SELECT d.t, min(doc_id) AS keep_id FROM d JOIN g ON d.t = g.t AND d.n = g.n GROUP BY d.t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t JOIN k ON d.t = k.t
"""
