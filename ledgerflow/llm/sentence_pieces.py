"""SentencePiece encoding with a prefix table, and decoding.

Of all tokens that end a prefix of a text, one is the last token of the merge encoding of that prefix. An automaton over
the vocabulary gives the tokens that end at each position; the one stays that is compatible with the last token of
the prefix before it, that is, the two side by side merge to just these two. The ids are then read backwards from the
last position. Two adjacent tokens decide alone: a merge across their border would happen between the two as well.

No piece holds a space mark after another character, so texts split before runs of space marks, and at characters
that no piece of two or more characters holds; the results of such parts are remembered in a table of bounded size.
The vocabulary and scores are read from the model file; both properties are checked when it is loaded.

Defined cases: a null text is an empty one and has no ids; characters outside the vocabulary become their bytes; nulls
elsewhere and repeated rows pass through, further columns are left out; a text of any length is encoded whole, in memory that grows
with its characters; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy, whole_text

MARK = "▁"
REMEMBERED_PARTS, REMEMBERED_PAIRS = 200_000, 200_000
SHIFT = 32
#: Rows of one Arrow batch that leaves a task.
ROWS = 512


class PrefixTable(dict):
    """part -> its ids as the bytes of 32-bit integers."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score, self.ids, self.byte_ids, self.raw = {}, {}, {}, []
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            self.raw.append(piece.replace(MARK, " ").encode())
            if sp.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.raw[k] = bytes([int(piece[3:5], 16)])
            elif sp.is_control(k):
                self.raw[k] = b""
            elif sp.is_unknown(k):
                self.raw[k] = " ⁇ ".encode()
            else:
                self.ids[piece], self.score[piece] = array("i", [k]), sp.get_score(k)
        if len(self.byte_ids) != 256 or sp.normalize(" a  ½\tb ") != f"{MARK}{MARK}a{MARK}{MARK}½\tb{MARK}":
            raise ValueError(f"{path}: only models with byte fallback and no normalisation are known here")
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError(f"{path}: a piece goes on after a space mark within it")
        self.alphabet = {c for piece in self.ids if len(piece) > 1 for c in piece}
        for c in self.alphabet - self.ids.keys():
            self.ids[c] = self.of_bytes(c)
        self.names = list(self.ids)
        numbers = {piece: k for k, piece in enumerate(self.names)}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 or piece in self.alphabet:
                self.automaton.add_word(piece, (len(piece), numbers[piece], self.ids[piece].tobytes()))
        self.automaton.make_automaton()
        inner = "".join(map(re.escape, sorted(self.alphabet - {MARK})))
        self.parts = re.compile(f"{MARK}*[{inner}]+|{MARK}+|.", re.DOTALL).findall
        self.pairs: dict[int, bool] = {}  # by both numbers in one integer; no token in front counts as number -1

    def of_bytes(self, char: str) -> array:
        return array("i", [self.byte_ids[b] for b in char.encode("utf-8", "replace")])

    def merged(self, text: str) -> list[str]:
        """Short texts: the pair with the best score merges, the leftmost of equals."""
        symbols, score = list(text), self.score.get
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                if (s := score(symbols[k] + symbols[k + 1])) is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        two = [self.names[k] for k in (left, right) if k >= 0]
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << SHIFT | right] = self.merged("".join(two)) == two
        return known

    def __missing__(self, part: str) -> bytes:
        if len(part) == 1 and part not in self.alphabet:
            return (self.ids[part] if part in self.ids else self.of_bytes(part)).tobytes()
        last, back, known = [-1] + [None] * len(part), [None] * (len(part) + 1), self.pairs.get
        for end, found in self.automaton.iter(part):
            if last[end + 1] is None:
                start, number = end + 1 - found[0], found[1]
                fits = known(last[start] << SHIFT | number)
                if fits or fits is None and self.compatible(last[start], number):
                    last[end + 1], back[end + 1] = number, found
        at, ids = len(part), []
        while at:
            ids.append(back[at][2])
            at -= back[at][0]
        ids.reverse()
        out = b"".join(ids)
        if len(part) <= 64:
            if len(self) >= REMEMBERED_PARTS:
                self.clear()
            self[part] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as the bytes of 32-bit integers."""
        return b"".join(map(self.__getitem__, self.parts(MARK + text.replace(" ", MARK)))) if text else b""

    def decode(self, ids) -> str:
        """The text of ids; the space in front that encoding adds is taken off, bytes that form no character become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) per row of docs: the ids of its whole text and the text that they decode to."""
    path = _path(path)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tidy()  # what tasks of other kinds have left
        own = prefix_table(path)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                rows = batch.slice(k, ROWS)
                ids = [own.encode(t) for t in rows.column(1).to_pylist()]
                decoded = [own.decode(memoryview(x).cast("i")) for x in ids]
                ends = array("i", [0])
                for x in ids:
                    ends.append(ends[-1] + len(x) // 4)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends.tobytes())]), values)
                yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    out = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_decode()'s rows."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents")))
