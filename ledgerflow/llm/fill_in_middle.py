"""Fill-in-the-middle by secondary sort: documents are cut into pieces, keyed by document and place in the output, and streamed in order.

A document of n code points is cut at two places that its id decides; the output puts the parts behind the marks `<P>`, `<S>` and `<M>`. Each
task gives out pieces of at most PIECE code points with their place. They are dealt by document and sorted within partitions (the
DataFrame form of repartitionAndSortWithinPartitions), so that a document of any length streams through one running digest. On
the way the marks tell where each piece stood in the text; sorted again inside the same partitions, without a further exchange,
the pieces give the restored text, which streams into the second digest. No document is held whole after it is cut.

Defined cases: a null text is an empty one; an empty text, and one that holds a mark, is plain; a null id is cut like an empty
id; rows that repeat an id, or are alike, are documents of their own, told apart by their place in the table, so the table's rows must
come in a stable order, as files do; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import table, whole_text

#: Code points of a piece.
PIECE = 4096
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
#: Of 100 documents these are plain, and of the others these begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20
#: Where the part behind a mark stands in the text.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: A row of digests sorts behind the pieces of its document.
BEHIND = 3


def cut(text: str, seed: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The form, and (mark, begin, end) of the parts in the order of the output; seed's hash decides."""
    n, digest = len(text), hashlib.sha256(seed.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= 100 - PLAIN:
        return "plain", [("", 0, n)]
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, n)
    return ("spm", [suffix, prefix, middle]) if h4 % 100 < SUFFIX_FIRST else ("psm", [prefix, suffix, middle])


def _pieces(batches: Iterator[pa.RecordBatch], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    kinds = [kind, pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names)

    for batch in batches:
        out = []
        for doc, row, seed, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            text = text.as_py()
            form, parts = cut(text, seed)
            place = 0
            for mark, begin, end in parts:
                for at in range(begin, max(end, begin + 1), PIECE):
                    out.append((doc, row, form, place, mark if at == begin else "", text[at : min(at + PIECE, end)]))
                    place += 1
                    if len(out) >= 1024:
                        yield batch_of(out)
                        out = []
        yield batch_of(out)


def _schema(kind: T.DataType, more: str) -> T.StructType:
    return T._parse_datatype_string(f"doc_id {kind.simpleString()}, {more}")


def fim_pieces(docs: DataFrame, salt: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, form, place, mark, body), all pieces of a document in one partition in the order of its output: mark and body, one after another."""
    kind = docs.schema[id_col].dataType
    own = F.col(f"`{id_col}`")
    rows = docs.select(own.alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.concat(F.lit(f"{salt}:"), F.coalesce(own.cast("string"), F.lit(""))).alias("seed"), whole_text(F.col(f"`{text_col}`")).alias("text"))
    schema = _schema(kind, "row long, form string, place int, mark string, body string")
    names, arrow = schema.names, to_arrow_type(kind)
    pieces = rows.mapInArrow(lambda batches: _pieces(batches, names, arrow), schema)
    return pieces.repartition("row").sortWithinPartitions("row", "place")


def _texts(batches: Iterator[pa.RecordBatch], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    now, said = None, []
    one = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([now[1]], pa.int64()), pa.array([now[2]], pa.string()), pa.array(["".join(said)], pa.string())], names)
    for batch in batches:
        for doc, row, form, _, mark, body in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[1] != row:
                if now:
                    yield one()
                now, said = (doc, row, form), []
            said += (mark, body)
    if now:
        yield one()


def fim_texts(pieces: DataFrame) -> DataFrame:
    """(doc_id, row, form, output): the whole outputs, one document at a time; for corpora whose documents fit in a row."""
    kind = pieces.schema["doc_id"].dataType
    schema = _schema(kind, "row long, form string, output string")
    names, arrow = schema.names, to_arrow_type(kind)
    return pieces.mapInArrow(lambda batches: _texts(batches, names, arrow), schema)


_DIGESTS = "n long, prefix_chars long, middle_chars long, output_sha256 string"


def _outputs(batches: Iterator[pa.RecordBatch], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the output: each with its place in the text, then a row of the document's digest and lengths."""
    kinds = [kind, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    now, sha, lengths, section = None, None, [], 0

    def ended() -> tuple:
        doc, row, form = now
        cuts = (None, None) if form == "plain" else (lengths[PLACE[PREFIX]], lengths[PLACE[MIDDLE]])
        return (doc, row, form, BEHIND, 0, None, sum(lengths), *cuts, sha.hexdigest())

    for batch in batches:
        out = []
        for doc, row, form, place, mark, body in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[1] != row:
                if now:
                    out.append(ended())
                now, sha, lengths, section = (doc, row, form), hashlib.sha256(), [0, 0, 0], 0
            if mark:
                section = PLACE[mark]
            sha.update(mark.encode())
            sha.update(body.encode())
            lengths[section] += len(body)
            out.append((doc, row, form, section, place, body, None, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)], names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(ended(), kinds)], names)


def _restored(batches: Iterator[pa.RecordBatch], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the text, each document's row of digests behind them: that row with the digest of the restored text."""
    kinds = [kind, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    sha = hashlib.sha256()
    for batch in batches:
        out = []
        for doc, _, form, section, _, body, *digest in zip(*(c.to_pylist() for c in batch.columns)):
            if section < BEHIND:
                sha.update(body.encode())
            else:
                out.append((doc, form, *digest, sha.hexdigest()))
                sha = hashlib.sha256()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)], names)


def digests(pieces: DataFrame) -> DataFrame:
    """(doc_id, form, n, prefix_chars, middle_chars, output_sha256, restored_sha256) of fim_pieces as they come; the restored text is made from the output's pieces alone."""
    kind = pieces.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    placed, final = _schema(kind, f"row long, form string, section int, place int, body string, {_DIGESTS}"), _schema(kind, f"form string, {_DIGESTS}, restored_sha256 string")
    placed_names, names = placed.names, final.names
    outputs = pieces.mapInArrow(lambda batches: _outputs(batches, placed_names, arrow), placed)
    return outputs.sortWithinPartitions("row", "section", "place").mapInArrow(lambda batches: _restored(batches, names, arrow), final)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = digests(fim_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
 ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
