r"""Personal data: base patterns, and terms that reveal them, by an information-theoretic test; DataFrame operations only.

Base spans are the leftmost non-overlapping matches of four patterns, kept if they pass their check (all parts of an address at most
255; 13 to 19 digits with a Luhn sum; 9 to 15 digits). Positions are running sums of the lengths of matches and of what lies between
them. The patterns are those of the contract with possessive loops, and they start only where a run of their characters starts or a match
has just ended. Running sums take n log n steps in the number of matches; pieces of a text are cut out of chunks of it, so no text
takes quadratic time or deep recursion.

A protected entity is a distinct value, a term a run of three or more letters and digits in lower case. Everything is counted in
occurrences of terms outside base spans: N in all documents, n_t of the term, m_e of any terms within CONTEXT code points of the entity, n_te of the term there.
PMI = log2(N n_te / (n_t m_e)) is what the term tells of the entity, and IC = -log2(m_e / N) is all that there is to tell; PMI / IC is 1
for a term that stands nowhere else. As IC grows with the corpus, a share of it alone would let ever more ordinary words pass; so a term must also leave at
most LEFT bits of IC untold, which doesn't depend on the corpus: at LEFT = 1 half of its occurrences stand beside the entity. Such terms with PMI / IC
from GENERALISE on are generalised, from REMOVE on removed, in all documents, those without a base span included, where they overlap no base span.

Every pair is tested, those seen once too: a name beside one address in one document discloses the most. But a rare ordinary word has the same
counts. What tells them apart is how many such pairs there are: terms that stand near no entity show how often an ordinary term has a count, and so how
many pairs of each cell (n_te, n_t, entities of about one m_e) chance alone puts side by side. Where these are more than 1 - SURE of the pairs
that the cell holds, its terms pass for ordinary. Both numbers grow with the corpus alike, so the bar doesn't.

Defined cases: a null text is an empty one without spans; rows that repeat an id, or have none, are reported each and counted each;
an empty table gives an empty result; further columns are left out by find() and kept by sanitise(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, row_hash, sieve, sifted, staged, table, whole_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IN = r"[\p{L}\p{M}\p{N}]"
TERM = rf"{_IN}{{3,}}+"
CONTEXT = 80
GENERALISE, REMOVE = 0.75, 0.9
#: Bits of an entity's IC that a term may leave untold, and the share of a cell's pairs that chance must leave unexplained.
LEFT, SURE = 1.0, 0.5
#: Code points of a chunk.
CHUNK = 256
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once for each row however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The array of join over values up to each place, in log n rounds: in round k each place meets the one 2^k before it."""

    def rounds(v: Column) -> Column:
        last = F.greatest(F.ceil(F.log2(F.greatest(F.size(v), F.lit(2)))).cast("int") - 1, F.lit(0))
        strides = F.transform(F.sequence(F.lit(0), last), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        meet = lambda acc, stride: F.transform(acc, lambda x, i: F.when(i >= stride, join(x, F.get(acc, i - stride))).otherwise(x))
        return F.aggregate(strides, v, meet)

    return let(values, rounds)


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """The code points of a text from start to end, read from its chunks alone."""
    first = (start / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, ((end - 1) / CHUNK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(held, start % CHUNK + 1, end - start)).otherwise("")


def spans_of(text: Column, pattern: Column, kind: Column) -> Column:
    """array<struct<kind, start, end, value>> of all matches; code points, end exclusive."""

    def placed(found: Column) -> Column:
        hits = found["hits"]
        steps = F.zip_with(F.transform(found["between"], F.length), F.concat(F.array(F.lit(0)), F.transform(hits, F.length)), lambda a, b: a + b)
        starts = F.slice(running(steps, lambda a, b: a + b), F.lit(1), F.size(hits))
        return F.zip_with(hits, starts, lambda hit, start: F.struct(kind.alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value")))

    return let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("between")), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether every second digit from the right doubled, and digit sums taken, all add up to a multiple of ten."""

    def add(total: Column, k: Column) -> Column:
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int") * (2 - k % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ip":
        short = lambda part: F.regexp_replace(part, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(short(p)) <= 3, short(p).cast("int") <= 255).otherwise(False))
    return F.lit(True)


def _passing(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _passes(kind, s["value"]))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind as listed, then start."""
    none = F.array().cast(_SPANS)
    found = []
    for kind in KINDS:
        needed = F.contains(text, F.lit("@" if kind == "email" else "+")) if kind in ("email", "phone") else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][\\x20-]?[0-9]")
        all_spans = spans_of(text, F.lit(PATTERNS[kind]), F.lit(kind))
        found.append(F.when(needed, _passing(all_spans, kind)).otherwise(none))
    return F.concat(*found)


def _contexts(text: Column, base: Column) -> Column:
    """array<struct<entity, terms>>: the terms that lie whole within CONTEXT code points of each base span."""

    def around(whole: Column) -> Column:
        chunks, length = whole["chunks"], whole["length"]

        def one(s: Column) -> Column:
            before = piece(chunks, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
            after = piece(chunks, s["end"], F.least(s["end"] + CONTEXT, length))
            # terms that the context or the entity cuts are left out
            before = F.when(s["start"] > CONTEXT, F.regexp_replace(before, rf"^{_IN}++", "")).otherwise(before)
            before = F.when(s["value"].rlike(rf"^{_IN}"), F.regexp_replace(before, rf"{_IN}++$", "")).otherwise(before)
            after = F.when(F.length(after) == CONTEXT, F.regexp_replace(after, rf"{_IN}++$", "")).otherwise(after)
            after = F.regexp_replace(after, rf"^{_IN}++", "")
            return F.struct(F.md5(F.concat_ws(":", s["kind"], F.lower(s["value"]))).alias("entity"), _terms(F.concat_ws(" ", before, after)).alias("terms"))

        return F.transform(base, one)

    return let(F.struct(chunks_of(text).alias("chunks"), F.length(text).alias("length")), around)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def revealing_terms(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, term, ratio) of the terms that reveal an entity; marked: rows with contexts, texts: (text) of all documents."""
    each = marked.where(F.size("contexts") > 0).select(F.explode("contexts").alias("c")).select("c.entity", F.explode("c.terms").alias("term"))
    pairs = staged(each.groupBy("entity", F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n_te")), "beside")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("ratio"))
    # terms of the entities themselves don't count
    inside = marked.where(F.size("base") > 0).select(F.explode("base.value").alias("value")).select(F.explode(_terms(F.col("value"))).alias("term"), F.lit(-1).alias("one"))
    every = texts.select(F.explode(_terms(F.col("text"))).alias("term"), F.lit(1).alias("one")).unionByName(inside)
    counts = staged(every.groupBy(F.lower("term").alias("term")).agg(F.sum("one").alias("n_t")).where("n_t > 0"), "terms")
    n = counts.agg(F.sum("n_t")).first()[0]
    if n is None:  # whatever stands beside an entity stands in another
        return pairs.select("entity", "term", F.lit(0.0).alias("ratio")).limit(0)
    m = staged(pairs.groupBy("entity").agg(F.sum("n_te").alias("m_e")), "entities")
    rated = staged(pairs.join(m, "entity").join(counts, "term").withColumns({"n_te": F.least("n_te", "n_t"), "about": _about()}), "pairs")
    cells = expected_by_chance(rated, m, counts, n).where(F.col("expected") <= (1 - SURE) * F.col("seen"))
    told = rated.withColumn("ratio", disclosed(n)).where((F.col("ratio") >= GENERALISE) & (F.log2(F.col("n_t") / F.col("n_te")) <= LEFT))
    return staged(told.join(cells, ["n_te", "n_t", "about"], "left_semi").select("entity", "term", "ratio"), "revealing")


def _about() -> Column:
    return F.floor(F.log2(F.col("m_e").cast("double"))).cast("int")


def expected_by_chance(rated: DataFrame, m: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(n_te, n_t, about, seen, expected): the pairs that a cell holds, and those that it would hold if its terms stood anywhere.

    q is an entity's share of the occurrences outside contexts, were its context one of them. Of terms with n_t occurrences that stand in no context
    there are Z; then Z n_t q pairs of one occurrence are expected, and at most Z 2^(n_t H(n_te / n_t)) q^n_te of more (H: the binary entropy,
    which bounds the number of ways).
    """
    away = counts.groupBy("n_t").agg(F.count(F.lit(1)).alias("all")).join(rated.select("term", "n_t").distinct().groupBy("n_t").agg(F.count(F.lit(1)).alias("near")), "n_t")
    away = away.select("n_t", (F.col("all") - F.col("near")).cast("double").alias("z"))  # a row a count
    outside = F.greatest(F.lit(float(n)) - F.sum("m_e"), F.lit(1.0))
    q = m.crossJoin(F.broadcast(m.agg(outside.alias("outside")))).withColumns({"q": F.col("m_e") / F.col("outside"), "about": _about()})  # one row
    groups = q.groupBy("about").agg(F.sum("q").alias("q_sum"), F.max("q").alias("q_max"), F.count(F.lit(1)).alias("entities"))  # a row a power of two
    cells = rated.groupBy("n_te", "n_t", "about").agg(F.count(F.lit(1)).alias("seen")).join(away, "n_t").join(groups, "about")
    a, b = F.col("n_te").cast("double"), F.col("n_t").cast("double")
    part = lambda x: F.when(x > 0, x * F.log2(b / x)).otherwise(0.0)
    several = F.col("z") * F.col("entities") * F.pow(F.lit(2.0), F.least(part(a) + part(b - a) + a * F.log2("q_max"), F.lit(500.0)))
    return cells.select("n_te", "n_t", "about", "seen", F.when(F.col("n_te") == 1, F.col("z") * b * F.col("q_sum")).otherwise(several).alias("expected"))


def disclosed(n: int) -> Column:
    """PMI / IC of n_te, n_t and m_e among n occurrences."""
    pmi = F.log2(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("m_e")))
    return F.coalesce(F.try_divide(pmi, F.log2(F.lit(float(n)) / F.col("m_e"))), F.lit(0.0))


def _apart(terms: Column, base: Column) -> Column:
    """The spans of terms that overlap no base span; both in order of start, terms without overlaps."""
    as_rows = lambda spans, is_term: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_term).alias("term"), s["end"].alias("end"), s["value"].alias("value")))

    def split(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda r: F.when(r["term"] == 0, r["end"]).otherwise(0)), F.greatest)
        # a base span that begins within a term is the next row
        cut = lambda r, i: F.coalesce((F.get(rows, i + 1)["term"] == 0) & (F.get(rows, i + 1)["start"] < r["end"]), F.lit(False))
        whole = F.zip_with(rows, reach, lambda r, m: F.struct(r.alias("r"), m.alias("reach")))
        own = F.filter(whole, lambda z, i: (z["r"]["term"] == 1) & (z["reach"] <= z["r"]["start"]) & ~cut(z["r"], i))
        return F.transform(own, lambda z: z["r"])

    return let(F.sort_array(F.concat(as_rows(base, 0), as_rows(terms, 1))), split)


def _added(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, row_hash, added) of the documents that hold revealing terms, one row for each (doc_id, row_hash)."""
    told = staged(terms.groupBy("term").agg(F.max("ratio").alias("ratio")), "told")
    held = texts.select("doc_id", "row_hash", F.explode(F.array_distinct(F.transform(_terms(F.col("text")), F.lower))).alias("term"))
    held = sieve(held, "term", told.select("term")).join(told.select("term"), "term", "left_semi")
    pairs = staged(held.select("doc_id", "row_hash", F.xxhash64("doc_id", "row_hash").alias("pair")).distinct(), "holding")
    own = sieve(texts.withColumn("pair", F.xxhash64("doc_id", "row_hash")), "pair", pairs.select("pair")).dropDuplicates(["pair", "doc_id", "row_hash"])
    spans = _apart(spans_of(F.col("text"), F.lit(TERM), F.lit("term")), base_spans(F.col("text")))
    each = own.select("doc_id", "row_hash", "pair", F.explode(spans).alias("s")).select("doc_id", "row_hash", "pair", "s.start", "s.end", "s.value", F.lower("s.value").alias("term"))
    each = sieve(each, "term", told.select("term")).join(told, "term")
    kind = F.when(F.col("ratio") >= REMOVE, "term_removed").otherwise("term_generalised")
    spans = F.sort_array(F.collect_list(F.struct("start", "end", "value", kind.alias("kind"))))
    added = each.groupBy("pair", "doc_id", "row_hash").agg(spans.alias("spans"))
    return staged(added.select("pair", "doc_id", "row_hash", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("added")), "added")


def _joined_by_pair(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with the further columns of spans, a table with one row for each (pair, doc_id, row_hash)."""
    own = spans.withColumnsRenamed({"pair": "own_pair", "doc_id": "own_id", "row_hash": "own_hash"})
    same = (F.col("pair") == F.col("own_pair")) & (F.col("row_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    return rows.join(own, same, "left").drop("own_pair", "own_id", "own_hash")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, base, added) per row of docs: arrays of (kind, start, end, value).

    Added spans are of kind term_generalised or term_removed, in order of start, and overlap no base span.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), row_hash(text_col).alias("row_hash"), whole_text(text_col).alias("text"))
    marked = texts.withColumn("base", base_spans(F.col("text")))
    marked = marked.withColumn("contexts", F.when(F.size("base") > 0, _contexts(F.col("text"), F.col("base"))))
    marked = staged(marked.select("doc_id", "row_hash", "base", "contexts"), "marked")
    none, rows = F.array().cast(_SPANS), marked.select("doc_id", "row_hash", "base")
    terms = revealing_terms(marked, texts)
    if terms.isEmpty():
        return rows.withColumn("added", none)
    added = _added(texts, terms)
    named, others = sifted(rows.withColumn("pair", F.xxhash64("doc_id", "row_hash")), "pair", added.select("pair"))
    found = _joined_by_pair(named, added).select("doc_id", "row_hash", "base", F.coalesce("added", none).alias("added"))
    return found.unionByName(others.drop("pair").withColumn("added", none))


def sanitised(text: Column, base: Column, added: Column) -> Column:
    """The text with base spans named by kind and terms generalised to a word or removed; spans that overlap are replaced together, under the first one's name."""
    shown = lambda kind: F.when(kind == "term_removed", "").when(kind == "term_generalised", "[word]").otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    spans = F.sort_array(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def with_reach(x: Column) -> Column:
        return let(F.struct(x["chunks"].alias("chunks"), x["spans"].alias("spans"), running(F.transform(x["spans"], lambda s: s["end"]), F.greatest).alias("reach")), put)

    def put(x: Column) -> Column:
        at = lambda k: F.coalesce(F.get(x["reach"], k - 1), F.lit(0))
        one = lambda s, k: F.concat(piece(x["chunks"], at(k), s["start"]), F.when(s["start"] >= at(k), shown(s["kind"])).otherwise(""))
        return F.concat(F.array_join(F.transform(x["spans"], one), ""), piece(x["chunks"], at(F.size(x["spans"])), F.length(text)))

    return let(F.struct(chunks_of(text).alias("chunks"), spans.alias("spans")), with_reach)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the sanitised text in place of the text; rows without spans keep theirs, and are not shuffled."""
    spans = find(docs, id_col, text_col).where((F.size("base") > 0) | (F.size("added") > 0)).dropDuplicates(["doc_id", "row_hash"])
    spans = staged(spans.withColumn("pair", F.xxhash64("doc_id", "row_hash")), "spans")
    rows = packed(docs, F.col(id_col).alias("doc_id"), row_hash(text_col).alias("row_hash")).withColumn("pair", F.xxhash64("doc_id", "row_hash"))
    named, others = sifted(rows, "pair", spans.select("pair"))
    named = _joined_by_pair(named, spans).select("row", "base", "added")
    own = F.col("row")[text_col]
    text = F.when(F.col("base").isNull(), own).otherwise(sanitised(whole_text(own), F.col("base"), F.col("added")))
    new = named.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
    return new.unionByName(others.select("row.*"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [_count("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))
