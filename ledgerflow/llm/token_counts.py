"""Token counts by byte-pair merging with a heap and a linked list.

A text splits at the added special strings (one token each) and then by the vocabulary's word pattern. The symbols of a
word, its UTF-8 bytes, form a linked list; a heap holds the ranks of adjacent pairs. The lowest rank pops first and
its pair merges if it still stands there. The count is initial symbols minus merges; no identifiers are made. Counts
of words are remembered in a table of bounded size for each worker.

Defined cases: a null text is an empty one and has 0 tokens; nulls elsewhere, repeated rows and further columns pass
through, but one of the name of the new column, which gives way to it; texts of any length take n log n time in the length of their longest word; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, whole_text

#: How the byte-level vocabulary splits a text into words (a fixed value of the tokenizer's format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
LIMIT = 512
#: Bits for a symbol, and for a place in a word, inside one integer.
SHIFT, PLACES = 32, 40
PLACE = (1 << PLACES) - 1


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes themselves, the others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class PairCounter(dict):
    """word -> tokens; counts a word when it is first asked for."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        letters, vocab = byte_letters(), model["vocab"]
        self.first = [vocab[letters[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left symbol, right symbol) in one integer -> rank; by rank, the symbol that the pair becomes
        self.rank = {vocab[a] << SHIFT | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens of a kind that is not known here")
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(WORDS).findall

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.symbols_left(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = n
        return n

    def symbols_left(self, word: bytes) -> int:
        n, rank, merged = len(word), self.rank.get, self.merged
        symbols = [self.first[b] for b in word]
        ranks = [rank(a << SHIFT | b, -1) for a, b in zip(symbols, symbols[1:])]  # of each symbol and its right neighbour
        heap = [r << PLACES | k for k, r in enumerate(ranks) if r >= 0]
        if not heap:
            return n
        ranks.append(-1)
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        merges = 0
        while heap:
            popped = heappop(heap)
            left = popped & PLACE
            if ranks[left] != popped >> PLACES:
                continue  # one of the two has merged since
            merges += 1
            symbol = symbols[left] = merged[popped >> PLACES]
            gone = after[left]
            ranks[gone] = -1
            beyond = after[left] = after[gone]
            r = -1
            if beyond < n:
                before[beyond] = left
                if (r := rank(symbol << SHIFT | symbols[beyond], -1)) >= 0:
                    heappush(heap, r << PLACES | left)
            ranks[left] = r
            if (prior := before[left]) >= 0:
                r = ranks[prior] = rank(symbols[prior] << SHIFT | symbol, -1)
                if r >= 0:
                    heappush(heap, r << PLACES | prior)
        return n - merges

    def count(self, text: str) -> int:
        if not self.special:
            return sum(map(self.__getitem__, self.words(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words(part))) for part in parts)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PairCounter:
    return PairCounter(path)


def with_token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """docs with one more column: the tokens of each whole text for the vocabulary file at path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for batch in batches:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    return docs.withColumn(out_col, tokens(whole_text(text_col)))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
