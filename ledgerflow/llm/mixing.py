"""Mixing sources to target weights, with DataFrame operations only.

Token counts add up by source (a partial aggregate, so a source that holds most rows costs no more than the rest);
targets come from the weights; each document is then taken floor(rate) times and once more if its draw, a hash of its id and text, falls
below a bound, so a lost task that runs again takes the same copies. The bound stands about where the rate's fraction does: of all bounds it is the one
for which the words of the source's documents below it come nearest to what is left of the target. Each document is below it with about the
probability of the fraction, and what a source takes is off its target by half a document at most.

Targets: the sources share `share` of all tokens by weight; no target exceeds `cap` times its source's size. In the
order of cap / weight, the sources that reach their cap come first; the level is what is left over for each unit of
weight.

Defined cases: a null text has size 0 and is taken like any other; rows without a source form one source, the last;
rows that repeat an id and a text are taken alike; a source of size 0 has target 0 and none of its rows is taken; an empty table
gives an empty result; a text of any length is counted whole; further columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, packed, running_sums, staged, table, whole_text

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size); weights repeat over the sources by code point, null last.

    Places and levels are running sums over ranges of the sources, so sources may be as many as documents.
    """
    by_name = F.col("source").asc_nulls_last()
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    placed = running_sums(by_source, [by_name], {"place": "one"})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    steps = placed.withColumn("weight", w).withColumn("bound", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("bound") / F.col("weight"))
    steps = running_sums(steps, [F.col("ratio"), by_name], {"before": "bound", "weight_before": "weight"})
    steps = staged(steps.select("source", "source_size", "weight", "bound", "ratio", "before", "weight_before"), "steps")
    whole = steps.agg((F.sum("source_size") * F.lit(share)).alias("total"), F.sum("weight").alias("weights"))  # one row
    level = (F.col("total") - F.col("before")) / (F.col("weights") - F.col("weight_before"))
    levels = steps.crossJoin(F.broadcast(whole)).agg(F.max(F.when(level <= F.col("ratio"), level)).alias("level"))  # one row
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("bound")).otherwise(F.col("level") * F.col("weight"))
    return steps.crossJoin(F.broadcast(levels)).select("source", "source_size", target.alias("target"))


def draw_of(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """48 bits of a hash of the id and the text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(text))), 1, 12), 16, 10).cast("long")


def bounds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, times, upto): documents are taken `times`, and once more where their draw is at most upto (-1: none).

    sizes: (source, size, draw). Words below each draw are running sums over ranges, so no source is in one task.
    """
    words = sizes.groupBy("source", "draw").agg(F.sum("size").alias("words"))
    summed = staged(running_sums(words, [F.col("source").asc_nulls_last(), F.col("draw")], {"ahead": "words"}), "draws")
    times = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    facts = targets.withColumn("times", times).withColumn("left", F.greatest(F.col("target") - F.col("times") * F.col("source_size"), F.lit(0.0)))
    starts = summed.groupBy(F.col("source").alias("own")).agg(F.min("ahead").alias("start"))
    facts = staged(facts.join(starts, F.col("source").eqNullSafe(F.col("own"))).drop("own"), "facts")
    off = F.abs(F.col("ahead") + F.col("words") - F.col("start") - F.col("left"))
    met = summed.withColumnRenamed("source", "own").join(facts.select("source", "start", "left"), F.col("own").eqNullSafe(F.col("source")))
    best = met.groupBy("own").agg(F.min(F.struct(off.alias("off"), "draw")).alias("best"))
    found = facts.join(best, F.col("source").eqNullSafe(F.col("own")))
    return found.select("source", "source_size", "target", "times", F.when(F.col("best.off") < F.col("left"), F.col("best.draw")).otherwise(F.lit(-1).cast("long")).alias("upto"))


def _sized(docs: DataFrame, id_col: str, seed: str) -> DataFrame:
    """(doc_id, source, size, draw) per row of docs, written once."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), "source", word_count(whole_text()).alias("size"), draw_of(F.col(f"`{id_col}`"), whole_text(), seed).alias("draw"))
    return staged(rows, "sizes")


def _copies() -> Column:
    return (F.col("times") + (F.col("draw") <= F.col("upto")).cast("int")).cast("int")


def mix_table(docs: DataFrame, id_col: str = "doc_id", seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row of docs."""
    sizes = _sized(docs, id_col, seed)
    known = bounds(sizes, source_targets(sizes)).withColumnRenamed("source", "own")
    met = sizes.join(known, F.col("source").eqNullSafe(F.col("own")))
    return met.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", seed: str = SEED) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; the columns of docs, whatever their names.

    The rows carry their whole text past no shuffle: only the bounds, one row a source, meet them.
    """
    sizes = _sized(docs, id_col, seed)
    known = staged(bounds(sizes, source_targets(sizes)).select("source", "times", "upto"), "bounds")
    rows = packed(docs, F.col("source").alias("own"), draw_of(F.col(f"`{id_col}`"), whole_text(), seed).alias("draw"))
    out = rows.join(known, F.col("own").eqNullSafe(F.col("source")))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), _copies())).alias("copy")).select("row.*")


def taken_deviation(mixed: DataFrame) -> DataFrame:
    """(source, source_size, target, taken, deviation) from mix_table()'s rows: the standard deviation that independent draws would have."""
    rate = F.coalesce(F.try_divide(F.first("target"), F.first("source_size")), F.lit(0.0))
    f = rate - F.floor(rate)
    squares = F.sum((F.col("size") * F.col("size")).cast("double"))
    return mixed.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.sqrt(f * (1 - f) * squares).alias("deviation"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix_table(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 2.0::DOUBLE AS bound FROM s),
r AS (SELECT *, bound / weight AS ratio, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(bound) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r),
m AS (SELECT max(lv) AS level FROM l WHERE lv <= ratio),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN bound ELSE level * weight END AS target FROM l, m),
u AS (SELECT d.doc_id, d.size, d.draw, t.source, t.source_size, t.target, floor(coalesce(t.target / nullif(t.source_size, 0), 0.0::DOUBLE)) AS times FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, draw, sum(size) AS words, any_value(greatest(target - times * source_size, 0.0::DOUBLE)) AS rest FROM u GROUP BY 1, 2),
h AS (SELECT *, abs(sum(words) OVER (PARTITION BY source ORDER BY draw) - rest) AS off FROM g),
b AS (SELECT source, CASE WHEN min(off) < any_value(rest) THEN first(draw ORDER BY off, draw) ELSE -1 END AS upto FROM h GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN draw <= upto THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source
"""
