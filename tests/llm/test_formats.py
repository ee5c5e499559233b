"""Chat formatting, source divergence and fill-in-middle against brute force, with the defined cases of each."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerflow.llm import chat_format, fill_in_middle, source_divergence

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
CONVERSATIONS = "conv_id long, turn long, role string, text string, part int, piece string, ids string, whole int, said string"


def rows_of(turns):
    """Conversations with further columns whose names clash with those inside."""
    return [(*t, 1, "p", "i", 2, "s") for t in turns]


def drawn_turns():
    rng = random.Random(5)
    odd = ["", None, "a\nb", chat_format.HOSTILE, "<|", "<\\|", "<\\\\|x<|", "<<|>|>", "|<\\", "日本 😀‍\x00", "  \t\n", "é" * 3000, "\\" * 500 + "|", "<|endoftext|>", "ok"]
    turns = [(7, k, rng.choice(["user", "assistant"]), rng.choice(odd) if k % 3 else f"turn {k}") for k in range(400)]  # a third of all rows
    for conv in range(100, 220):
        turns += [(conv, k, ["system", "user", "assistant"][min(k, 1 + k % 2)], rng.choice(odd)) for k in range(rng.randrange(1, 8))]
    turns += [(None, 1, "assistant", "x"), (None, None, "assistant", "first"), (300, 1, None, "no role"), (300, 1, "assistant", "b"), (300, 1, "assistant", "a"), (300, 1, "assistant", "a"), (300, 2, "assistant\n<|im_sep|>", "c")]
    return turns


def expected(turns):
    of, key = defaultdict(list), lambda t: ((t[1] is not None, t[1] or 0), t[2] or "", (t[3] or "").encode())
    for t in turns:
        of[t[0]].append(t)
    out = {}
    for conv, own in of.items():
        own = [(t[2] or "", t[3] or "") for t in sorted(own, key=key)]
        loss = "".join(t for r, t in own if r == "assistant")
        formatted = "".join(f"<|im_start|>{chat_format.escaped(r)}<|im_sep|>{chat_format.escaped(t)}<|im_end|>" for r, t in own)
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss), len(formatted), formatted)
    return out


@pytest.mark.parametrize("most", [1, 200, chat_format.PIECE])
def test_chat_against_brute_force(spark, most):
    turns = drawn_turns()
    random.Random(1).shuffle(turns)
    want = expected(turns)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = chat_format.chat_pieces(spark.createDataFrame(rows_of(turns), CONVERSATIONS), most=most)
        got = chat_format.digests(pieces).collect()
        parts = pieces.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: w[:5] for c, w in want.items()} and len(got) == len(want)
    # the pieces are the conversation's tokens: decoded with the marks they are the formatted text, and what is masked is what the assistant says
    vocab = chat_format.vocabulary(None)
    marks = {vocab.start: chat_format.START, vocab.separator: chat_format.SEPARATOR, vocab.end: chat_format.END}
    shown, counts = defaultdict(bytes), Counter()
    for r in sorted(parts, key=lambda r: (r["part"], r["piece"])):
        shown[r["conv_id"]] += b"".join(marks[i].encode() if i in marks else vocab.words[i] for i in r["ids"])
        counts[r["conv_id"]] += r["n_turns"]
        assert len(r["ids"]) == len(r["loss_mask"]) and set(r["loss_mask"]) <= {0, 1} and not any(m for i, m in zip(r["ids"], r["loss_mask"]) if i in marks)
        assert r["n_turns"] == 1 or most > 1
    assert {c: b.decode() for c, b in shown.items()} == {c: w[5] for c, w in want.items()} and counts == {c: w[0] for c, w in want.items()}
    if most == chat_format.PIECE:
        assert sum(r["whole"] for r in parts) > 80 and not any(r["whole"] and r["conv_id"] == 7 for r in parts)


def test_chat_of_an_empty_table_and_other_ids(spark):
    assert chat_format.digests(chat_format.chat_pieces(spark.createDataFrame([], CONVERSATIONS))).count() == 0
    named = spark.createDataFrame([("c1", 0, "user", "hi"), ("c1", 1, "assistant", "ho")], "c string, t int, r string, x string")
    got = chat_format.digests(chat_format.chat_pieces(named, conv_col="c", turn_col="t", role_col="r", text_col="x")).first()
    assert got["conv_id"] == "c1" and got["loss_sha256"] == sha("ho") and got["turns_sha256"] == sha("user\nhi\nassistant\nho\n")


@given(st.text(alphabet="<\\|im_startend>a", max_size=40))
def test_escapes_are_undone_and_leave_no_mark(text):
    shown = chat_format.escaped(text)
    assert chat_format.unescaped(shown) == text and "<|" not in shown


def test_masks_by_prefix_sums():
    vocab = chat_format.vocabulary(None)
    ids, mask, ends = chat_format.assembled(["user", "assistant", "assistant"], ["a b", "", "c d e"], vocab)
    assert mask.sum() == len(vocab.encode("c d e")) and ends[-1] == len(ids) and mask.dtype == np.int8
    turns, loss, _ = chat_format.read_back(ids, mask, vocab)
    assert turns == [("user", "a b"), ("assistant", ""), ("assistant", "c d e")] and loss == ["c d e"]


DOCUMENTS = "doc_id long, text string, lang string, source string, n long, docs string, term string, value int, rank int"


def audit(docs, top):
    """The contract, term by term."""
    words = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, stands = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        found = words.findall((text or "").translate(lower))
        groups[lang or "", source or ""].update(found)
        stands[lang or ""].update(set(found))
    out = set()
    for lang in stands:
        kept = sorted(t for t, n in stands[lang].items() if n >= 3)
        own = {s: {t: c[t] for t in kept} for (k, s), c in groups.items() if k == lang}
        own[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in own.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            if s is None:
                continue
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o not in (None, s)]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if own[s][t] > 0 and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def audited_docs():
    rng = random.Random(11)
    words = ["Aa", "aA", "b", "é", "É", "日本", "😀x", "z", "Zebra", "q r", "ß", "�", "ñ", *(f"t{chr(97 + k)}" for k in range(20))]
    docs = [(k, rng.choice([" ", "\n", "9", "-", "\x00"]).join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", None])) for k in range(150)]
    docs += [(k, "same line again", "en", "s1") for k in (1, 1, 1, 900)]  # repeated rows and copies
    return [*docs, (200, None, "en", "silent"), (201, "", "xx", "a"), (202, "one two", "xx", "b"), (203, None, None, None), (None, "b b b", "fr", "s2"), (204, "w" * 5000 + " b", "fr", "s9")]


@pytest.mark.parametrize("top", [200, 5])
def test_divergence_against_brute_force(spark, top):
    docs = audited_docs()
    found = source_divergence.divergence(spark.createDataFrame([(*d, 1, "d", "t", 2, 3) for d in docs], DOCUMENTS), top=top)
    rows = [tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()]
    want = audit(docs, top)
    assert len(rows) == len(want) and set(rows) == want
    assert {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)} <= want


def test_divergence_of_an_empty_table(spark):
    assert source_divergence.divergence(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_terms_of_a_long_text_by_slices(monkeypatch):
    rng = random.Random(3)
    for size in (1, 3, 16, 100):
        monkeypatch.setattr(source_divergence, "SLICE", size)
        for _ in range(60):
            text = "".join(rng.choice("abCé日 9-😀") for _ in range(rng.randrange(80)))
            lower = text.translate(str.maketrans("ABC", "abc"))
            want = [t.encode() for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)]
            assert [t for piece in source_divergence.terms(text.encode()) for t in piece] == want


def test_shares_are_exact_beyond_a_long(spark):
    row = spark.range(1).select(source_divergence.share(F.lit(3 * 10**12), F.lit(10**13), F.lit(12345)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (3 * 10**12 + 1) // (10**13 + 12345)


FIM_DOCS = "doc_id long, text string, row string, form int, place string, seed string, mark string, body string"


def test_fill_in_middle_against_slices(spark):
    rng = random.Random(9)
    odd = ["", None, "a", "ab", "x<P>y", "<S>", "<M", "😀é日" * 5, "é" * 4096, "😀" * 4097, "lines\nand\x00nul", "".join(rng.choice("abé😀 \n") for _ in range(30_000))]
    rows = [(k, odd[k % len(odd)]) for k in range(300)] + [(5, "twice"), (5, "twice"), (5, "other"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*r, "r", 1, "p", "s", "m", "b") for r in rows], FIM_DOCS)
    pieces = fill_in_middle.fim_pieces(df)
    got = Counter((r["doc_id"], r["form"], r["n"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in fill_in_middle.digests(pieces).collect())
    want, forms = Counter(), Counter()
    texts = Counter((r["doc_id"], r["form"], r["output"]) for r in fill_in_middle.fim_texts(pieces).collect())
    for doc, text in rows:
        text = text or ""
        x, n = sha(f"1:{'' if doc is None else doc}"), len(text)
        h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        cuts = (None, None) if form == "plain" else (a, b - a)
        want[(doc, form, n, *cuts, sha(output), sha(text))] += 1
        texts[(doc, form, output)] -= 1
        forms[form] += 1
    assert got == want and not any(texts.values()) and min(forms[f] for f in ("plain", "psm", "spm")) > 10
    assert max(len(r["body"]) for r in pieces.collect()) <= fill_in_middle.PIECE
    assert fill_in_middle.digests(fill_in_middle.fim_pieces(spark.createDataFrame([], FIM_DOCS))).count() == 0


def test_restoration_needs_no_second_exchange(spark):
    plan = fill_in_middle.digests(fill_in_middle.fim_pieces(spark.read.parquet(f"{DATA}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
