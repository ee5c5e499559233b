"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash draws for each shingle one random permutation of the signature's slots and one random fraction for each step; slot
k keeps the least step + fraction. All shingles of a document take a step together, and steps stop as soon as no slot can
get smaller, after one or two for most documents. Slots agree with the probability of the Jaccard similarity, with less
variance than independent hashes.

Documents with equal sets form a class, and only its smallest id goes on. BANDS bands of ROWS slots put the classes into
buckets: at similarity 0.75 two classes miss each other with probability 5e-6. No bucket gives all its pairs. First each
class meets one of its bucket, the hub; the pairs are confirmed on the full sets and the links grouped. Most
buckets are then within one component and done. The classes of the others go into new buckets, by those of their rarest shingles
of which similar sets must share one. There hubs from a bucket's smallest components meet the classes of other
components, are done with, and the next round follows. The work of a round is linear in the bucket rows: as fewer buckets stay
open, each gets more hubs. Every pair of a bucket is either confirmed, refused, or within one component already.

Defined cases: a null text is an empty one; a document without words has an empty set and is linked with nothing; with fewer
than five words the sequence of words is the one shingle; rows without an id are linked by equal sets only; rows that
repeat an id and a text get the same result each; all shingles of a text of any length count, and its set stands whole in memory; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_hash, sieve, staged, table, tidy, whole_text, without_rows
from .components import components

WORDS, SLOTS, ROWS = 5, 128, 4
BANDS = SLOTS // ROWS
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Hubs of a round times open bucket rows, for each bucket row of the first round.
PAIRS_PER_ROW = 2
#: Distinct words whose hashes a task remembers.
REMEMBERED = 150_000
FRACTION = np.uint64(40)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, seed=5)
        return found


_word_hashes = _WordHashes()
_PLACE = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(max(WORDS, ROWS))]


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the runs of five words, sorted; words as between ASCII white space, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    run = min(WORDS, len(words))
    if not run:
        return hashes
    n = len(words) - run + 1
    total = np.full(n, run, np.uint64)
    for k in range(run):
        total += _mix(hashes[k : k + n]) * _PLACE[k]
    return np.unique(_mix(total))


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: per slot the least step * 2^40 + fraction over all elements."""
    best = np.full(slots, _MASK, np.uint64)
    places, rows = None, np.arange(len(elements))
    for step in range(slots):
        if step and int(best.max()) >> 40 < step:
            break  # what follows is larger than every slot
        drawn = _mix(elements + np.uint64((step + 1) * 0xD1B54A32D192ED03 & _MASK))
        chosen = (step + ((drawn >> FRACTION) * np.uint64(slots - step) >> np.uint64(24))).astype(np.int64)
        value = (drawn & np.uint64((1 << 40) - 1)) | np.uint64(step << 40)
        if not step:
            slot = chosen
        else:
            if places is None:
                places = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                places[rows, first] = 0
            slot = places[rows, chosen]
            places[rows, chosen] = places[:, step]
        if not step:
            first = chosen
        np.minimum.at(best, slot, value)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        total += _mix(parts[:, k]) * _PLACE[k]
    return _mix(total)


def _signed(batches: Iterator) -> Iterator:
    """(doc_id, row_hash, text) -> (doc_id, row_hash, n, hash of the set, band keys)."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            sets = [shingles(t) for t in rows.column(2).to_pylist()]
            marks = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
            bands = [band_keys(signature(s)).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.string()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "row_hash", "n", "mark", "bands"])
    _word_hashes.clear()  # workers outlive their tasks
    tidy()


def _sets(batches: Iterator) -> Iterator:
    """(doc_id, text) -> (doc_id, set)."""
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            sets = [shingles(t).view(np.int64) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])
    _word_hashes.clear()
    tidy()


def _full_sets(nodes: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, set) of the classes in nodes; the text of one row of each is read anew."""
    needed = staged(nodes.distinct().join(classes.select("node", F.col("row_hash").alias("own")), "node"), "needed")
    texts = sieve(texts, "doc_id", needed.select("node"))
    # an inner join: a semi join would be moved below the sieve, and all texts shuffled
    own = texts.join(needed, (texts["doc_id"] == needed["node"]) & (texts["row_hash"] == needed["own"])).select(texts["*"])
    return staged(own.dropDuplicates(["doc_id", "row_hash"]).select("doc_id", "text").mapInArrow(_sets, "node long, set array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes, those whose full sets are similar."""
    a, b = (sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return staged(pairs.join(a, "a").join(b, "b").where(100 * both >= SIMILAR * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"), "links")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(key, node, n, rest): of each set the rarest elements, as many as similar sets must share one of, without those that no other set has.

    A set of n elements whose similarity with another is 0.75 or more misses at most n - ceil(0.75 n) of its own. rest counts
    the element and what follows in the order by rarity; the first element that two sets share bounds the intersection by
    either rest, so rows whose rest is too small for the smallest set of their bucket are left out.
    """
    each = sets.select("node", F.size("set").cast("long").alias("n"), F.explode("set").alias("key"))
    counts = staged(each.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1"), "counts")
    held = each.join(counts, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("held"))
    length = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1 - (F.col("n") - F.size("held"))
    found = held.where(length > 0).select("node", "n", F.size("held").cast("long").alias("size"), F.posexplode(F.slice("held", F.lit(1), length.cast("int"))).alias("p", "e"))
    found = staged(found.select("e.key", "node", "n", (F.col("size") - F.col("p")).alias("rest")), "elements")
    least = staged(found.groupBy("key").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", "least"), "least")
    enough = _bound("rest", "n", F.greatest(F.col("least"), F.ceil(F.col("n") * SIMILAR / 100)))
    return found.join(least, "key").where(enough).select("key", "node", "n", "rest")


def _bound(most, n, other):
    """Whether an intersection of `most` elements can make sets of these sizes similar."""
    most, n, other = (F.col(x) if isinstance(x, str) else x for x in (most, n, other))
    return most * (100 + SIMILAR) >= SIMILAR * (n + other)


def _alike(n: str, other: str):
    """Whether sets of these sizes can be similar."""
    return 100 * F.least(n, other) >= SIMILAR * F.greatest(n, other)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, n_shingles, component_id, kept) per row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("row_hash"), whole_text(text_col).alias("text"))
    marks = staged(texts.mapInArrow(_signed, "doc_id long, row_hash long, n long, mark string, bands array<long>"), "marks")
    classes = staged(marks.where("n > 0").groupBy("mark", "n").agg(F.min("doc_id").alias("node"), F.min_by("row_hash", "doc_id").alias("row_hash"), F.first("bands").alias("bands")), "classes")
    members = classes.where("node IS NOT NULL").select("node", "n", F.col("n").alias("rest"), F.explode("bands").alias("key"))
    shared = staged(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "keys")
    # rows of one bucket are the classes that still have to meet others of it
    rows = staged(members.join(shared, "key"), "rows")
    links, found, sets, first_rows = None, None, None, 0
    while True:
        held = rows if found is None else rows.join(found, "node", "left")
        held = staged(held.select("key", "node", "n", "rest", (F.col("node") if found is None else F.coalesce("component", "node")).alias("component")), "held")
        parts = staged(held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n", "rest")).alias("hub")), "parts")
        buckets = parts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("main"))
        buckets = staged(buckets.where("k > 1").select("key", "all", F.col("main.component").alias("main")), "buckets")
        left = buckets.agg(F.sum("all").alias("rows")).first()["rows"]
        if not left:
            break
        if links is not None and sets is None:
            open_rows = held.join(buckets.select("key"), "key", "left_semi")
            sets = _full_sets(open_rows.select("node"), texts, classes)
            rows = staged(_prefixes(sets), "prefixes")
            continue
        first_rows = first_rows or left
        each = 1 if sets is None else max(1, PAIRS_PER_ROW * first_rows // left)
        # hubs stand for the smallest components of a bucket, never for its largest
        rank = F.row_number().over(W.partitionBy("key").orderBy("size", "component"))
        minor = parts.join(buckets.select("key", "main"), "key").where("component <> main").withColumn("rank", rank).where(F.col("rank") <= each)
        hubs = staged(minor.select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.rest").alias("hub_rest"), F.col("component").alias("hub_component")), "hubs")
        met = held.join(hubs, "key").where(F.col("component") != F.col("hub_component")).where(_alike("n", "hub_n") & _bound(F.least("rest", "hub_rest"), "n", "hub_n"))
        pairs = staged(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
        new = _confirmed(pairs, sets if sets is not None else _full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), texts, classes))
        links = new if links is None else links.unionByName(new)
        found = components(links)
        if sets is not None:
            open_rows = held.join(buckets.select("key"), "key", "left_semi")
            rows = open_rows.join(hubs.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti").select("key", "node", "n", "rest")
            rows = staged(rows, "rows")
    known = classes.select("mark", F.col("n").alias("size"), "node")
    if found is not None:
        known = known.join(found, "node", "left").select("mark", "size", F.coalesce("component", "node").alias("top"))
    else:
        known = known.withColumnRenamed("node", "top")
    known = staged(known, "tops")
    out = marks.join(known, (marks["mark"] == known["mark"]) & (marks["n"] == known["size"]), "left")
    component = F.when(F.col("n") > 0, F.col("top")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each group, with the columns of docs."""
    pairs = near_groups(docs, id_col, text_col).groupBy("doc_id", "row_hash").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    return without_rows(docs, pairs.where("NOT kept OR rows > 1").select("doc_id", "row_hash", (~F.col("kept")).alias("drop")), id_col, text_col)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("row_hash")
