"""Byte-level BPE and packing against the libraries, text by text."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from citeloom.llm import byte_bpe, packing

from test_packing_helpers import check_packed

ODD = [None, "", " ", "a", "I'll don't  x\t\n y ", "ß ﬁ \U0001f600‍! İ ΑΣ", "a\x1cb ! \x85 z", "<|endoftext|> <|startoftext|>x", "x" * 3000, "wörd, wörd. " * 900, "two  spaces " * 700 + "\n\n\n", "A.B, c.. d., 'S 's"]
WORD = P.path("word_bpe_49k.json")


def table(spark, texts):
    return spark.createDataFrame([(i if i != 5 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)


def reference():
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [65_536, 1_000])
def test_byte_bpe_equals_library(spark, monkeypatch, chunk):
    monkeypatch.setattr(byte_bpe, "CHUNK", chunk)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 200)
    enc, path = reference(), P.path("byte_bpe_multi_50k.tiktoken")
    texts = ODD + ODD[8:11]
    rows = byte_bpe.decode(byte_bpe.encode(table(spark, texts), path, P.PATTERN), path, P.PATTERN).collect()
    expected = sorted((np.array(enc.encode_ordinary(t or ""), np.uint32).tobytes(), (t or "").encode()) for t in texts)
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in rows) == expected


def test_byte_bpe_empty_table(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.encode(table(spark, ODD).limit(0), path, P.PATTERN).count() == 0


def test_packing_covers_every_id_once(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta.", "x1", "¿qué?"]
    texts = dict(enumerate([*ODD, *(" ".join(rng.choices(words, k=rng.randint(0, 1200))) for _ in range(60))]))
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    check_packed(packing.packed_documents(docs, WORD).collect(), texts)


def test_packing_very_long_text_and_clashing_columns(spark, monkeypatch):
    """A text of a megabyte, columns named like the output, and a plan too large to broadcast."""
    monkeypatch.setattr(packing, "SMALL", 0)
    texts = {1: "alpha Beta, " * 90_000, 2: None, 3: "x"}
    docs = spark.createDataFrame([(i, t, "a", "b", -1) for i, t in texts.items()], "doc_id long, text string, ids string, row_hash string, length int")
    check_packed(packing.packed_documents(docs, WORD).collect(), texts)


def test_packing_one_document_and_none(spark):
    docs = spark.createDataFrame([(None, None), (None, None), (7, "a b")], "doc_id long, text string")
    rows = packing.packed_documents(docs, WORD).collect()
    assert sum(r.length for r in rows) == 5
    assert packing.packed_documents(docs.limit(0), WORD).count() == 0


def test_plan_leaves_no_slack():
    rng = random.Random(5)
    for counts in ({1: 1}, {1500: 7}, {700: 1000, 3: 2}, {n: rng.randint(1, 9) for n in rng.sample(range(1, 2049), 300)}):
        fill = {}
        for _, low, high, _, n, first, per, sequence, _ in packing.plan(counts):
            for t in range(high - low):
                fill[sequence + (first + t) // per] = fill.get(sequence + (first + t) // per, 0) + n
        assert sum(fill.values()) == sum(n * c for n, c in counts.items())
        assert all(v == 2048 or v & (v - 1) == 0 for v in fill.values())


def test_best_fill_is_best():
    rng = random.Random(9)
    for _ in range(60):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        counts = {n: items.count(n) for n in items}
        used = packing.best_fill(counts, 40)
        assert all(counts[n] >= k for n, k in used.items()) and max(items) in used
        others = list(items)
        others.remove(max(items))
        sums = {0}
        for n in others:
            sums |= {s + n for s in sums}
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= 40 - max(items)) + max(items)


def test_packed_ids_match_digests(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma " * (50 * i)) for i in range(9)], "doc_id long, text string")
    grid = packing.token_pieces(docs, WORD, 1)
    rows = packing.packed_ids(docs, packing.pack(grid.drop("ids")), WORD, 1).collect()
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert sum(r.length for r in rows) == grid.selectExpr("sum(length) n").first().n
    assert len({hashlib.md5(bytes(r.ids)).hexdigest() for r in rows}) > 1
