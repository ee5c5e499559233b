"""Which sources of a language say what the language says, and which terms set a source apart: exact audits by ranking count cells.

A term's share is a whole number of billionths, smoothed by one count for each kept term of the language. How far a share p lies from q is
f = floor((p - q)^2 / q), which depends on two counts only. So terms are grouped into cells by their counts, f is evaluated once a
cell, and a cell's multiplicity stands for its terms. All arithmetic is on whole numbers.

Counting is combined inside each task (bounded tables of terms, given out when full) before it is shuffled. Terms of a source: cells by (count in
the source, count in the language); cells of one value merge; the highest TOP values of a group bound what can rank, and only
the terms of their cells are expanded, in the order of their UTF-8 bytes. Pairs of sources: cells by the two counts of the terms that both have; terms
that one of them or none has are counted from each source's own cells, since the sum over all kept terms is
    sum over joint cells (f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0)) + sum over p's cells f(p,q0) + sum over q's cells f(p0,q) + (V - Vp - Vq) f(p0,q0)
with p0, q0 the shares of an absent term.

Defined cases: null text, lang and source count as ''; a document without terms still makes its group occur; repeated rows are documents of their own;
a language that keeps no term has pairs of value 0 and no terms; equal values rank by item; a text of any length is read in slices; an
empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

#: Documents of a language that a kept term stands in.
LEAST_DOCS = 3
TOP = 200
BILLION = 1_000_000_000
#: Entries of a task's table of terms, after which it is given out, and how many of them at a time; bytes of a text that are cut into terms at a time.
HELD, GIVEN, SLICE = 200_000, 20_000, 1 << 20
#: Bytes of terms, A-Z in lower case; others are spaces. Bytes from 0x80 on belong to letters outside ASCII.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a slice at a time; slices end between terms."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            piece = text[at:end].translate(_LETTERS)
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):  # one long term
                end = min(len(text), end + SLICE)
                piece = text[at:end].translate(_LETTERS)
                cut = piece.rfind(b" ", len(piece) - SLICE)
            if end < len(text):
                end, piece = at + cut + 1, piece[:cut]
        else:
            piece = text[at:].translate(_LETTERS)
        yield piece.split()
        at = end


_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of this task by group and term: occurrences and documents; a row without a term for each group."""
    counts, docs, held = {}, {}, 0

    def known() -> Iterator[pa.RecordBatch]:
        langs, sources, found, n, d = [], [], [], [], []
        for group, own in counts.items():
            langs += [group[0]] * (len(own) + 1)
            sources += [group[1]] * (len(own) + 1)
            found += [None, *(t.decode("utf-8") for t in own)]
            n += [0, *own.values()]
            d += [0, *map(docs[group].__getitem__, own)]
        whole = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])
        for at in range(0, whole.num_rows, GIVEN):
            yield whole.slice(at, GIVEN)

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            group = (lang, source)
            if group not in counts:
                counts[group], docs[group] = Counter(), Counter()
            own, before = Counter(), len(counts[group])
            for piece in terms(text.as_py()):
                own.update(piece)
            counts[group].update(own)
            docs[group].update(own.keys())
            held += len(counts[group]) - before
            if held >= HELD:
                yield from known()
                counts, docs, held = {}, {}, 0
    if counts:
        yield from known()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by group; a row with a null term for each group that occurs."""
    whole = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(whole(lang_col), whole(source_col), F.encode(whole(text_col), "UTF-8"))
    found = rows.mapInArrow(_counted, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(billion (count + 1) / (total + kept)), exact at any count."""
    return F.lit(1) + F.call_function("div", F.lit(BILLION).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), (total + kept).cast("decimal(19,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _summed(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' ranks the other sources of the language, part 'term' the terms that the source favours, to rank top."""
    counts = staged(term_counts(docs, lang_col, source_col, text_col), "counts")
    known = counts.where("term IS NOT NULL")
    kept = known.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = staged(known.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept")
    # one row a group: kept terms and occurrences of the language and of the source
    by_source = kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own_kept"), F.sum("n").alias("own_total"))
    by_lang = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(by_lang, "lang", "left").join(by_source, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "own_kept", "own_total"])
    groups = staged(groups.withColumn("absent", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("own_total"), F.col("kept")))), "groups")
    return _terms(kept, groups, top).unionByName(_pairs(kept, groups))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("terms")).join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("own_total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    cells = cells.withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", "n", "lang_n", "terms", distance(F.col("p"), F.col("q")).alias("value"))
    cells = staged(cells, "cells")
    # at most top values can rank, since each has a term
    down = W.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    values = values.withColumn("place", F.row_number().over(down)).where(F.col("place") <= top)
    ahead = F.coalesce(F.sum("terms").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("ahead", ahead).where(F.col("ahead") < top).select("lang", "source", "value", "ahead")
    chosen = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value", "ahead")
    found = kept.join(chosen, ["lang", "source", "n", "lang_n"])
    # tasks keep the first `top` terms of a value before they meet
    inside = F.row_number().over(W.partitionBy("lang", "source", "value").orderBy("term"))
    ranked = found.withColumn("inside", inside).where(F.col("inside") <= top).withColumn("rank", (F.col("ahead") + F.col("inside")).cast("int")).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select("lang", "source", "kept", "own_kept", "own_total", "absent")
    h = g.select("lang", *[F.col(c).alias(f"h_{c}") for c in ("source", "own_kept", "own_total", "absent")])
    pairs = staged(g.join(h, "lang").where("source <> h_source"), "pairs")  # one row for each row of the result
    # a term has one row a source here; both orders of a pair come from one joint cell
    left, right = kept.select("lang", "term", "source", "n"), kept.select("lang", "term", F.col("source").alias("h_source"), F.col("n").alias("h_n"))
    joint = left.join(right, ["lang", "term"]).where("source < h_source").groupBy("lang", "source", "h_source", "n", "h_n").agg(F.count(F.lit(1)).alias("terms"))
    joint = joint.unionByName(joint.select("lang", F.col("h_source").alias("source"), F.col("source").alias("h_source"), F.col("h_n").alias("n"), F.col("n").alias("h_n"), "terms"))
    p, q = share(F.col("n"), F.col("own_total"), F.col("kept")), share(F.col("h_n"), F.col("h_own_total"), F.col("kept"))
    met = pairs.select("lang", "source", "h_source", "kept", "own_total", "h_own_total", F.col("absent").alias("p0"), F.col("h_absent").alias("q0"))
    met = joint.join(met, ["lang", "source", "h_source"]).withColumns({"p": p, "q": q})
    a = lambda x, y: distance(F.col(x), F.col(y)).cast("decimal(38,0)")
    both = met.groupBy("lang", "source", "h_source").agg(_summed(F.col("terms") * (a("p", "q") - a("p", "q0") - a("p0", "q") + a("p0", "q0"))).alias("both"))
    own = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(groups.select("lang", "source", "own_total", "kept"), ["lang", "source"])
    own = own.select("lang", "source", "terms", share(F.col("n"), F.col("own_total"), F.col("kept")).alias("p"))
    first = own.join(pairs.select("lang", "source", "h_source", F.col("h_absent").alias("q0")), ["lang", "source"])
    first = first.groupBy("lang", "source", "h_source").agg(_summed(F.col("terms") * a("p", "q0")).alias("first"))
    second = own.select("lang", F.col("source").alias("h_source"), "terms", F.col("p").alias("q")).join(pairs.select("lang", "source", "h_source", F.col("absent").alias("p0")), ["lang", "h_source"])
    second = second.groupBy("lang", "source", "h_source").agg(_summed(F.col("terms") * a("p0", "q")).alias("second"))
    keys = ["lang", "source", "h_source"]
    none = (F.col("kept") - F.col("own_kept") - F.col("h_own_kept")).cast("decimal(38,0)") * distance(F.col("absent"), F.col("h_absent"))
    zero = F.lit(0).cast("decimal(38,0)")
    value = sum((F.coalesce(c, zero) for c in ("both", "first", "second")), F.coalesce(none, zero))
    found = pairs.join(both, keys, "left").join(first, keys, "left").join(second, keys, "left").select("lang", "source", F.lit("pair").alias("part"), F.col("h_source").alias("item"), value.cast("long").alias("value"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0)::HUGEINT AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (s.total + v.v) AS p, 1 + 1000000000::HUGEINT * (lang_n + 1) // (v.total + v.v) AS q
 FROM s JOIN k ON s.lang = k.lang JOIN v ON s.lang = v.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM x
 UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM t)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
