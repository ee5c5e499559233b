"""The corpus pipeline over documents: toxic documents go, exact and near copies go, sources are mixed, texts are encoded.

Every stage takes the rows that its predecessor kept; all but the last return the columns of documents.

Defined cases: a null text counts as an empty one in every stage and stays null until the last; all empty texts are one group of exact
copies; a null id is an id of its own, and its row survives exact dedup only where its group has no row with an id and
the same length; rows that repeat an id and a text become one; different texts under one id stay; a null source is a source; texts of
any length are read whole; an empty table gives an empty result; further columns, whatever their names, pass through to the last stage,
which gives doc_id, n_tokens, ids_sha256 and decoded_sha256 alone. These few columns are staged, as staging reads texts by small Arrow batches.
"""

from __future__ import annotations

from ledgerflow.llm import exact_dedup, mixing, near_dedup, sentence_pieces, toxicity
from ledgerflow.llm.common import staged, table, workspace

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup.exact_dedup(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: near_dedup.near_dedup(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("sentence_pieces", lambda spark, docs, sf_dir: staged(sentence_pieces.digests(sentence_pieces.encode_decode(docs)), "digests")),
]
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages one after another, each written as Parquet and read again; what a stage wrote on its way is removed then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with workspace(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
