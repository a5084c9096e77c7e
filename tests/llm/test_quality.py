"""Co-training on a small corpus with few labels."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from citeloom.llm import quality


def corpus(spark, n=300):
    rng = random.Random(2)
    rows, labels, truth = [], [], {}
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choices(["ta", "no", "mi", "re"], k=3)) for _ in range(rng.randint(20, 80))]
        text = " ".join(words) + "." if good else "!! ".join(w.upper() for w in words) + "$$$"
        rows.append((i, text, f"s{rng.randint(0, 3)}", "xx", 0.0))
        truth[i] = int(good)
        if i % 4 == 0:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, text_score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_quality_of_documents(spark):
    docs, labels, truth = corpus(spark)
    models = quality.fit(docs, labels)
    got = quality.score(docs, models).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 70 and np.mean([(r.quality_score >= 0.5) == bool(truth[r.doc_id]) for r in held]) > 0.97
    schema = "doc_id long, text string, source string, lang string, n_chars long, quality_score string, extra string"
    odd = spark.createDataFrame([(1, None, None, None, None, "q", "e"), (2, "", "s", "l", 0, "q", "e"), (None, "x", None, "l", 1, "q", "e"), (4, "tanomi " * 200_000, "s1", "xx", 7, "q", "e"), (5, "ta no", "s1", "xx", 5, "q", "e"), (5, "ta no", "s1", "xx", 5, "q", "e")], schema)
    scored = quality.score(odd, models).collect()
    assert all(0 <= r.quality_score <= 1 and r.extra == "e" for r in scored)
    assert len({r.quality_score for r in scored if r.doc_id == 5}) == 1
    assert quality.score(odd.limit(0), models).count() == 0
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.quality_score for r in quality.score(odd, None).collect()} == {0.5}


def test_logits_equal_features_times_weights():
    """Text: counts of trigrams in plain Python; page: the record's columns, whatever the text."""
    rng = np.random.default_rng(1)
    weights = [rng.normal(size=quality.N_TEXT + 1).astype("f4"), rng.normal(size=quality.N_PAGE + 1).astype("f4")]
    texts = ["abc abc", "", None, "zz", "¿qué tal?", "na" * 4000]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts, "source": ["a", None, "a", "b", "b", "a"], "lang": ["x", "x", None, "x", "y", "x"], "n_chars": [7, 0, None, 2, 9, 8000]})
    got = quality.view_logits(batch, weights)
    for i, text in enumerate(texts):
        raw, counts = (text or "").encode(), {}
        for j in range(len(raw) - 2):
            code = (raw[j] << 16 | raw[j + 1] << 8 | raw[j + 2]) * 2654435761 % 2**32 >> 21
            counts[code] = counts.get(code, 0) + 1
        total = max(1, sum(counts.values()))
        size, safe = len(raw), max(1, len(raw))
        kinds = [sum(quality.KINDS[b] == k for b in raw) / safe for k in range(8)]
        same = sum(a == b for a, b in zip(raw, raw[1:])) / safe
        lines, words = raw.count(b"\n") + 1, raw.count(b" ") + 1
        stats = [math.log1p(size) / 10, *kinds, math.log1p(lines) / 5, math.log1p(size / lines) / 10, size / words / 20, same]
        expected = sum((n / total) ** 0.5 * weights[0][c] for c, n in counts.items()) + np.dot(stats, weights[0][quality.BUCKETS : -1]) + weights[0][-1]
        assert np.isclose(got[0][i], expected, atol=1e-2 if i and texts[i - 1] and texts[i] and texts[i - 1][-1] == texts[i][0] else 1e-4)
    page = quality.page_features(batch)
    assert (page.sum(axis=1) == 4).all() and np.allclose(got[1], page @ weights[1][:-1] + weights[1][-1], atol=1e-4)
    assert (page == quality.page_features(batch.set_column(1, "text", pa.array(["other"] * 6)))).all()
    x = quality.text_features(batch.column("text"))
    assert np.allclose(got[0], x @ weights[0][:-1] + weights[0][-1], atol=1e-4)


def test_views_teach_each_other():
    """Documents that one view is sure about are labelled for the other."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    views = [np.stack([y + rng.normal(0, 0.3, 400), rng.normal(size=400)], axis=1).astype("f4") for _ in range(2)]
    calls = []

    def exchange(models, share):
        calls.append(share)
        out = []
        for view, w in enumerate(m["w"] for m in models):
            logit = views[view][40:] @ w[:-1] + w[-1]
            sure = np.argsort(-np.abs(logit))[: 40 * len(calls)]
            out.append((views[1 - view][40:][sure], (logit[sure] > 0).astype(int)))
        return out

    models = quality.co_train([v[:40] for v in views], y[:40], exchange)
    logit = np.mean([m["a"] * (v @ m["w"][:-1] + m["w"][-1]) + m["b"] for m, v in zip(models, views, strict=True)], axis=0)
    assert len(calls) == quality.ROUNDS and ((logit > 0) == (y == 1)).mean() > 0.95


def test_both_views_teach_in_the_real_exchange(spark):
    """Source and size tell of quality as the text does: each view is taught by the other, in the proportion of the classes."""
    rng = random.Random(5)
    rows, labels, truth = [], [], {}
    for i in range(900):
        good = rng.random() < 0.6
        words = ["".join(rng.choices(["ta", "no", "mi", "re"], k=3)) for _ in range(rng.randint(20, 60))]
        text = " ".join(words) + "." if good != (rng.random() < 0.1) else "!! ".join(w.upper() for w in words) + "$$$"
        source = f"s{rng.randint(0, 3) + 4 * (good != (rng.random() < 0.1))}"
        rows.append((i, text, source, "xx", len(text)))
        truth[i] = int(good)
        if i % 5 == 0:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    models = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), exchanged=60)
    assert all(m["taught"] >= 60 for m in models), [m["taught"] for m in models]
    got = quality.score(docs, models).collect()
    right = lambda name: np.mean([(r[name] >= 0.5) == bool(truth[r.doc_id]) for r in got])
    assert right("quality_score") > max(right("text_score"), right("page_score")) - 0.02 and right("quality_score") > 0.9
