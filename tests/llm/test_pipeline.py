"""The stages of the pipeline on a small corpus, each against brute force."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp

from test_models import texts as lines
from test_packing_helpers import check_packed
from test_simhash import slow_components, slow_fingerprint
from test_suffix_dedup import brute


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    rng, rows, labels = random.Random(6), [], []
    shared = lines(rng, "aa", 60)
    for i in range(260):
        lang, toxic = rng.choice(["aa", "bb"]), int(rng.random() < 0.3)
        text = lines(rng, lang, rng.randint(30, 120), "zzgrunk" if toxic else None)
        if i % 20 == 1:
            text = rows[-1][1]
        if i % 20 == 7:
            text = text + " " + shared
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, 1, int("zzgrunk" in text)))
    rows += [(900, None, None, None, None), (901, "", "aa", "s", 0), (902, "12 34 !!", "aa", None, 8)]
    path = tmp_path_factory.mktemp("tables")
    pq.write_table(pa.table(dict(zip(cp.COLUMNS, zip(*rows), strict=True))), path / "documents.parquet")
    pq.write_table(pa.table(dict(zip(["doc_id", "quality", "toxic"], zip(*labels), strict=True))), path / "labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (_, s1), (_, s2), (_, s3), (_, s4), (_, s5) = cp.STAGES
    one = s1(spark, docs, sf_dir).cache()
    assert one.columns == cp.COLUMNS and {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {900, 901, 902}
    two = s2(spark, one, sf_dir).cache()
    before, after = one.collect(), two.collect()
    wrong = [r for r in before if ("zzgrunk" in r.text) == (r.doc_id in {x.doc_id for x in after})]
    assert len(wrong) <= 0.05 * len(before)
    three = s3(spark, two, sf_dir).cache()
    prints = [(r.doc_id, slow_fingerprint(r.text)) for r in after]
    kept = {i for (i, _), c in zip(prints, slow_components(prints), strict=True) if i == c}
    assert sorted(r.doc_id for r in three.collect()) == sorted(kept)
    rows = three.collect()
    four = s4(spark, three, sf_dir).cache()
    expected = {r.doc_id: b[3].decode(errors="replace") for r, b in zip(rows, brute([(r.doc_id, r.text) for r in rows]), strict=True)}
    left = four.collect()
    assert {r.doc_id: r.text for r in left} == expected and all(r.n_chars == len(r.text) for r in left)
    check_packed(s5(spark, four, sf_dir).collect(), expected)


def test_run_on_whole_and_empty_tables(spark, sf_dir, tmp_path):
    assert cp.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for name in ("documents", "labels"):
        table = pq.read_table(f"{sf_dir}/{name}.parquet")
        pq.write_table(table.slice(0, 0), tmp_path / f"{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_rows_without_ids_and_repeated_rows(spark, sf_dir):
    rows = [(None, "a b c d e", "aa", "s", 9)] * 2 + [(5, "x y z w v u t", "aa", "s", 9)] * 3 + [(9, "x y z w v u t", "aa", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "None", "None"]


def test_different_texts_under_one_id(spark, sf_dir):
    near = " ".join(f"w{i}" for i in range(300))
    texts = [(1, near), (5, near), (5, "x y z w v u t"), (7, "k l m n o p q"), (7, "b c d e f g h i"), (7, "B c d e f g h i"), (7, "b c d e f g h i")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text.lower()) for r in cp.drop_near_duplicates(spark, docs.repartition(3), sf_dir).collect())
    assert got == [(1, near), (5, "x y z w v u t"), (7, "b c d e f g h i"), (7, "k l m n o p q")]
