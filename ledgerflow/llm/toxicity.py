"""Toxicity: compression distance with zstandard dictionaries, trained apart on ordinary and on toxic text.

Training takes a sample of labelled documents of bounded size, near copies left out. The library trains the ordinary dictionary on pieces of
ordinary documents. The toxic documents are dealt over FOLDS parts, and the library trains a small toxic dictionary on each part's windows that
the ordinary dictionary compresses worst: what ordinary text doesn't have stands there. A text is cut at white space into
windows of about WINDOW bytes; what a window saves with a toxic dictionary at hand beside the ordinary one, over the ordinary one alone, is its gain.
In ROUNDS more rounds each part's dictionary is trained on the windows that gain most from the other parts' dictionaries: what toxic documents share stays,
and what one of them happens to hold goes.
Fragments of prose that a toxic dictionary keeps by chance differ from part to part, toxic words don't, so a window counts by the mean
gain of all toxic dictionaries and by the second smallest. A logistic curve over the largest, the two largest, the summed
and the mean of both is calibrated on documents that the dictionaries haven't seen: toxic ones without their own part's dictionary, ordinary ones of a
part that the ordinary dictionary leaves out. The threshold, score 0.5, stands where the share of the caught less FALSE_ALARM times that of the
false alarms is largest among them.

Defined cases: a null text is an empty one and has no window; documents that labels mark both ways, or not at all, are not learnt
from; a row without an id is held out, as the hash of an empty one is; samples too small for the library's trainer are dictionaries as they are; without labels of both kinds all scores are 0; rows that
repeat an id are scored each; a text of any length is scored whole, its windows a few dozen bytes each; an empty table gives an empty result; score columns take the place of columns of these names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, staged, table, tidy, whole_text

#: Labelled documents that training takes at most, by class, of those that are no longer than this.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_BYTES = 3000, 9000, 100_000
#: Pieces of ordinary documents that the ordinary dictionary is trained on at most, and their code points.
PIECES, PIECE = 6000, 2048
#: Bytes of the ordinary dictionary and of a toxic one at most, and the share of its samples' bytes that a dictionary holds at most.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_SHARE, TOXIC_SHARE = 262_144, 4096, 4, 4
#: Toxic dictionaries; windows that each toxic document gives to one at least, and windows of all together at least.
FOLDS, WORST, WORST_IN_ALL, ROUNDS = 5, 3, 10_000, 2
#: What a window must gain to be trained on again, and what a share of false alarms costs against one of the caught.
AGAIN, FALSE_ALARM = 1.0, 5.0
#: The trainer's segment and match sizes for toxic and ordinary text.
SEGMENT, ORDINARY_SEGMENT, MATCH = 32, 32, 8
WINDOW, LEVEL, LEAST_GAIN = 32, 3, 2
THRESHOLD = 0.5
#: Texts whose windows are compressed together.
SLICE = 256
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: tuple[bytes, ...]
    weights: tuple[float, ...]


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(5)) == 0


def _trained(samples: list[bytes], size: int, share: int, segment: int) -> bytes:
    """The content of a dictionary that the library trains on the samples."""
    import zstandard

    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(512, min(size, total // share)), samples, k=segment, d=MATCH).as_bytes()
    except zstandard.ZstdError:  # too few samples, or too small ones
        return b" ".join(samples)[-size:]


@functools.lru_cache(maxsize=1)  # a worker meets one model at a time, and each takes some 15 MB
def _compressors(ordinary: bytes, toxic: tuple[bytes, ...]):
    import zstandard

    found = []
    for content in (ordinary, *[ordinary + t for t in toxic]):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        found.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return found


def windows(text: str) -> Iterator[bytes]:
    """The whole text in lower case, in windows of WINDOW bytes and on to the next white space, twice that at most."""
    data, at = text.lower().encode("utf-8", "replace"), 0
    while at < len(data):
        upto = min(len(data), at + 2 * WINDOW)
        space = _SPACE.search(data, at + WINDOW, upto)
        end = space.start() if space else upto
        yield data[at:end]
        at = end


def worst_windows(text: str, ordinary: bytes, n: int) -> list[bytes]:
    """The windows that the ordinary dictionary compresses worst for their length."""
    (plain,) = _compressors(ordinary, ())
    return sorted(windows(text), key=lambda w: -len(plain(w)) / max(len(w), MATCH))[:n]


def _saved(cut: list[list[bytes]], ordinary: bytes, toxic: tuple[bytes, ...]) -> tuple[dict[bytes, int], np.ndarray]:
    """The different windows with their places, and what each saves with each toxic dictionary; one dictionary is used for all windows before the next."""
    plain, *others = _compressors(ordinary, toxic)
    place = {w: n for n, w in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
    sizes = [np.fromiter(map(len, map(compress, place)), np.int64, len(place)) for compress in (plain, *others)]
    return place, sizes[0][:, None] - np.stack(sizes[1:], axis=1)


def _kinds(saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the mean gain and the second smallest."""
    return saved.mean(axis=1), np.sort(saved, axis=1)[:, min(1, saved.shape[1] - 1)].astype(float)


def gains(texts: pa.Array, ordinary: bytes, toxic: tuple[bytes, ...], without: list[int] | None = None) -> np.ndarray:
    """Of each text the largest, two largest, sum and mean of what its windows save: by the mean of the toxic dictionaries, then by the second smallest.

    Texts are taken by the slice: a window that they share is compressed once. without: the dictionary that doesn't count for each text.
    """
    out = np.zeros((len(texts), 8))
    if not toxic:
        return out
    for k in range(0, len(texts), SLICE):
        cut = [list(windows(t)) for t in texts[k : k + SLICE].to_pylist()]
        place, saved = _saved(cut, ordinary, toxic)
        left = without[k : k + SLICE] if without and len(toxic) > 1 else [-1] * len(cut)
        kinds = {x: _kinds(saved[:, [j for j in range(len(toxic)) if j != x]]) for x in set(left)}
        for row, own, x in zip(out[k:], cut, left):
            if own:
                at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
                for n, kind in enumerate(kinds[x]):
                    top = np.sort(kind[at])[::-1]
                    row[4 * n : 4 * n + 4] = top[0], top[:2].sum(), np.log1p(top[top >= LEAST_GAIN].sum()), top.mean()
    return out


def shared_windows(texts: list[str], ordinary: bytes, toxic: tuple[bytes, ...], without: list[int]) -> list[list[bytes]]:
    """Of each text the WORST windows that gain most from the dictionaries of the other parts, where they gain AGAIN at least."""
    found = []
    for k in range(0, len(texts), SLICE):
        cut = [list(dict.fromkeys(windows(t))) for t in texts[k : k + SLICE]]
        place, saved = _saved(cut, ordinary, toxic)
        for own, x in zip(cut, without[k : k + SLICE]):
            gain = saved[[place[w] for w in own]][:, [j for j in range(len(toxic)) if j != x or len(toxic) == 1]].mean(axis=1)
            found.append([own[n] for n in np.argsort(-gain, kind="stable")[:WORST] if gain[n] >= AGAIN])
    return found


def threshold(logit: np.ndarray, toxic: np.ndarray) -> float:
    """The logit from which on the share of the caught less FALSE_ALARM times that of the false alarms is largest; 0 without documents of both kinds."""
    bad, good = np.sort(logit[toxic == 1]), np.sort(logit[toxic == 0])
    if not len(bad) or not len(good):
        return 0.0
    at = np.sort(logit)[::-1]
    worth = (len(bad) - np.searchsorted(bad, at)) / len(bad) - FALSE_ALARM * (len(good) - np.searchsorted(good, at)) / len(good)
    return float(at[np.argmax(worth)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty)
        w += np.linalg.solve(curve, x.T @ (y - p) - penalty * w)
    return w


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, learn_from: Column) -> DataFrame:
    """(toxic, doc_id, text): the labelled documents to learn from, of bounded number and length, near copies left out."""
    marked = labels.where(learn_from).where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    # the draw is among those short enough, so that it is as large as it may be
    ranked = marked.join(texts.select("doc_id"), "doc_id", "left_semi").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = staged(ranked.where("toxic = 1").limit(TOXIC_SAMPLE).unionByName(ranked.where("toxic = 0").limit(ORDINARY_SAMPLE)), "sample_ids")
    words = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    size = F.size("words")
    # near copies share the least hash of their runs of five words
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(size - 4, F.lit(1))), lambda k: F.xxhash64(F.array_join(F.slice("words", k, 5), " "))))
    sample = texts.join(ids, "doc_id").withColumn("words", words).withColumn("least", least)
    return staged(sample.groupBy("toxic", "least").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d")).select("toxic", "d.*"), "sample")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_from: Column | None = None) -> Model:
    """learn_from: a condition on labels' rows; by default those that are not held out."""
    sample = _sample(docs, labels, id_col, text_col, ~held_out(F.col(id_col)) if learn_from is None else learn_from)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    pieces = F.regexp_extract_all(F.lower("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    seen = sample.where("toxic = 0 AND fold <> 0")
    pieces = seen.select("doc_id", F.posexplode(pieces).alias("at", "piece")).orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(PIECES)
    ordinary = _trained([r["piece"].encode("utf-8", "replace") for r in pieces.select("piece").collect()], ORDINARY_BYTES, ORDINARY_SHARE, ORDINARY_SEGMENT)  # PIECES rows at most

    bad = sample.where("toxic = 1")
    each = max(WORST, -(-WORST_IN_ALL // max(1, bad.count())))

    @F.arrow_udf("array<binary>")
    def worst(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([worst_windows(t.as_py(), ordinary, each) for t in batch], pa.list_(pa.binary()))

    toxic, place = _by_part(bad.select("fold", "doc_id", worst("text").alias("windows")))
    if not ordinary or not toxic:
        return Model(b"", (), (0.0,))
    for _ in range(ROUNDS):
        before, known = toxic, place

        @F.arrow_udf("array<binary>")
        def shared(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, folds in batches:
                own = [known.get(f, -1) for f in folds.to_pylist()]  # noqa: B023
                yield pa.array(shared_windows(texts.to_pylist(), ordinary, before, own), pa.list_(pa.binary()))  # noqa: B023

        toxic, place = _by_part(bad.select("fold", "doc_id", shared("text", "fold").alias("windows")))
        if not toxic:  # nothing is shared
            toxic, place = before, known

    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, folds in batches:
            own = [place.get(f, -1) for f in folds.to_pylist()]
            yield pa.array(list(gains(texts, ordinary, toxic, own)), pa.list_(pa.float64()))

    # an ordinary document does without one dictionary too, so that all are measured alike
    unseen = sample.where("toxic = 1 OR fold = 0").withColumn("fold", F.when(F.col("toxic") == 0, F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)).cast("int")).otherwise(F.col("fold")))
    rows = unseen.select("toxic", "doc_id", measured("text", "fold").alias("x")).orderBy("doc_id").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows])
    weights = _logistic(x, y)
    weights[0] -= threshold(weights[0] + x @ weights[1:], y)
    return Model(ordinary, toxic, tuple(map(float, weights)))


def _by_part(rows: DataFrame) -> tuple[tuple[bytes, ...], dict[int, int]]:
    """A toxic dictionary for each part that has windows, and its place; rows: (fold, doc_id, windows), bounded by TOXIC_SAMPLE, WORST and WORST_IN_ALL."""
    found = rows.orderBy("doc_id").collect()
    parts = {k: [bytes(w) for r in found if r["fold"] == k for w in r["windows"]] for k in range(FOLDS)}
    kept = [k for k, part in parts.items() if part]
    return tuple(_trained(parts[k], TOXIC_BYTES, TOXIC_SHARE, SEGMENT) for k in kept), {k: n for n, k in enumerate(kept)}


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on)."""
    ordinary, toxic, weights = model.ordinary, model.toxic, np.array(model.weights)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if len(weights) == 1:
                yield pa.array(np.zeros(len(batch)))
            else:
                x = gains(batch, ordinary, toxic)
                yield pa.array(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))))
        _compressors.cache_clear()
        tidy()

    return docs.withColumn("score", score(whole_text(text_col))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with the columns of docs."""
    model = fit(docs, labels)
    kept = with_scores(packed(docs, whole_text().alias("text")), model)
    return kept.where("predicted = 0").select("row.*")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_scores(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
