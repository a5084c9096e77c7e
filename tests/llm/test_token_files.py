"""Token files: round trips and the library's ids."""

import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from citeloom.llm import token_files as tf
from citeloom.llm.word_tokens import splits_at_spaces, word_tokenizer

WORD = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(0, 70000, 7))])
def test_numbers_round_trip(values):
    x = np.array(values, np.uint32)
    control, data = tf.encode_numbers(x)
    assert len(control) == -(-len(x) // 4)
    assert (tf.decode_numbers(control, data, len(x)) == x).all()


def test_corpus_round_trip(spark, tmp_path):
    texts = [(7, "Hello, World. hello"), (3, None), (None, "z z z"), (9, ""), (-2, "naïve ΣΑΣ 12"), (3, "again a b"), (11, "word " * 4000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, ids int").repartition(3)
    tf.write_corpus(docs, WORD, 2, str(tmp_path / "c"))
    rows = sorted(tf.read_corpus(spark, str(tmp_path / "c")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -2, 3, 3, 7, 9, 11]
    library, at = Tokenizer.from_file(WORD), 0
    by_ids = {}
    for i, t in texts:
        by_ids.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids in by_ids[r.doc_id]
        at += len(ids)
    assert zlib.crc32(bytes(rows[1].ids)) == zlib.crc32(np.array(by_ids[-2][0], "<u4").tobytes())


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tf.write_corpus(docs, WORD, 2, str(tmp_path / "e"))
    assert tf.read_corpus(spark, str(tmp_path / "e")).count() == 0


def test_words_equal_the_library_on_odd_strings():
    """Random strings of awkward characters, in one column, against the library text by text."""
    rng = random.Random(12)
    alphabet = [*"aZé'.,!0９ß\t\n \x85\u2028\xa0", "'s", "'LL", "İ", "ﬁ", "e\u0301", "Σ", "中", "\U0001f600", "<|", "|>", "<|endoftext|>", "word", "WORD", "\x1c", "\u0345"]
    texts = [None, "", *("".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(6_000))]
    own, library = word_tokenizer(WORD), Tokenizer.from_file(WORD)
    for part in (texts[:3_000], texts[3_000:], [t for t in texts if t and "<|" not in t]):
        ids, n = own.encode(pa.array(part, pa.string()))
        ends = np.cumsum(n)
        for text, a, b in zip(part, ends - n, ends, strict=True):
            assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_other_settings_are_left_to_the_library(tmp_path):
    settings = json.loads(Path(WORD).read_text())
    assert splits_at_spaces(settings)
    settings["normalizer"] = None
    assert not splits_at_spaces(settings)
    (tmp_path / "other.json").write_text(json.dumps(settings))
    own = word_tokenizer(str(tmp_path / "other.json"))
    ids, n = own.encode(pa.array(["Ab c", None, "x"]))
    library = Tokenizer.from_file(str(tmp_path / "other.json"))
    assert ids.tolist() == [i for t in ("Ab c", "", "x") for i in library.encode(t, add_special_tokens=False).ids] and n[1] == 0
