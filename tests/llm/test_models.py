"""Language and toxicity models: gradients, held-out accuracy, odd input."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from citeloom.llm import language_id, toxicity

SYLLABLES = {"aa": ["ba", "be", "bo", "bu"], "bb": ["xi", "xo", "xu", "xy"]}


def texts(rng, lang, n, insult=None):
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]
    if insult:
        words.insert(rng.randrange(len(words)), insult)
    return " ".join(words)


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang, toxic = rng.choice(["aa", "bb"]), int(rng.random() < 0.4)
        rows.append((i, texts(rng, lang, rng.randint(20, 200), rng.choice(["zzgrunk", "zzgrump"]) if toxic else None), lang if i % 7 else None, "s", -1.0))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def odd(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "ba be bo"), (4, "ba be bo"), (4, "ba be bo"), (5, "xi xo " * 5000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_language_accuracy_and_odd_rows(spark):
    docs, _, rows, _ = corpus(spark)
    model = language_id.fit(docs)
    assert model["languages"] == ["aa", "bb"]
    got = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([got[r[0]].lang_pred == ("aa" if "b" in r[1][:9] else "bb") for r in held]) > 0.97
    out = language_id.identify(odd(spark), model).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "aa", "aa", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in out)
    assert language_id.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(odd(spark), None).collect()} == {"und"}
    assert language_id.identify(odd(spark).limit(0), model).count() == 0
    assert set(language_id.position_labels(model, "ba be bo")) <= {"aa", "bb"}


def test_fast_scores_equal_plain_recurrence():
    rng = np.random.default_rng(0)
    model = language_id.new_model(["a", "b", "c"])
    text = bytes(rng.integers(97, 123, 300).tolist()).decode()
    fast = language_id.document_probabilities(model, pa.array([None, text, "x"]))
    raw, total = np.frombuffer(text.encode(), np.uint8), np.zeros(3)
    for at in range(0, 300, language_id.WINDOW):
        x = raw[at : at + language_id.WINDOW][:, None]
        fw, bw = language_id.run_direction(model["f"], x), language_id.run_direction(model["b"], x[::-1])[::-1]
        for a, b in zip(fw, bw, strict=True):
            p = np.exp(model["f"]["w"] @ a + model["b"]["w"] @ b + model["bias"])[:, 0]
            total += p / p.sum()
    assert np.allclose(fast[1], total / 300, atol=1e-5) and not fast[0].any()


def test_toxicity_catches_misspellings_and_leaves_clean_text(spark):
    docs, labels, rows, marks = corpus(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxic_score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    held = [(i, t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([(got[i] >= 0.7) == bool(t) for i, t in held]) > 0.97
    scores = toxicity.score_column(model, pa.array(["ba be zzgrunkk bo", "ba zzgrumps", "xi xo " * 3000, "xi xo " * 3000 + "zzgrunk"]))
    assert (scores[[0, 1, 3]] > 0.7).all() and scores[2] < 0.5
    assert all(0 <= r.toxic_score <= 1 for r in toxicity.score(odd(spark), model).collect())
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.score(odd(spark).limit(0), model).count() == 0


def test_grams_equal_plain_slicing():
    words = ["a", "", "héllo", "ab"]
    _, counts = toxicity.grams_of(pa.array(words))
    sizes = [len(w.encode()) + 2 for w in words]
    assert counts.tolist() == [1 + sum(max(0, n - g + 1) for g in toxicity.GRAMS) for n in sizes]


def test_language_gradients_equal_finite_differences():
    rng = np.random.default_rng(2)
    model = language_id.new_model(["a", "b", "c"])
    weights = {(s, k): model[s].__setitem__(k, model[s][k].astype("f8")) or model[s][k] for s in "fb" for k in ("table", "u", "w")}
    model["bias"] = model["bias"].astype("f8")
    weights["bias"] = model["bias"]
    x, y = rng.integers(97, 103, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = language_id.gradients(model, x, y)
    for key, w in weights.items():
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in w.shape) if key != ("f", "table") and key != ("b", "table") else (int(x[rng.integers(7), rng.integers(5)]), int(rng.integers(w.shape[1])))
            was, sides = w[at], []
            for step in (1e-3, -1e-3):
                w[at] = was + step
                sides.append(language_id.gradients(model, x, y)[0])
            w[at] = was
            assert abs((sides[0] - sides[1]) / 2e-3 - grads[key][at]) < 2e-5


def test_toxicity_scores_equal_a_sum_word_by_word():
    """Every word's n-grams, every segment's words, every document's segments, in plain Python."""
    rng = np.random.default_rng(4)
    model = {"scores": rng.normal(0, 3, toxicity.BUCKETS).astype("f4"), "bias": -1.0}
    mask = (1 << 64) - 1

    def buckets(word):
        raw, out = b"<" + word.encode() + b">", []
        for size in toxicity.GRAMS:
            for i in range(len(raw) - size + 1):
                h = 1469598103934665603
                for byte in raw[i : i + size]:
                    h = (h ^ byte) * 1099511628211 & mask
                out.append((h * 0x9E3779B97F4A7C15 & mask) >> 48)
        whole = sum(byte * pow(0x100000001B3, i + 1, 1 << 64) for i, byte in enumerate(raw)) & mask
        return [*out, (whole * 0x9E3779B97F4A7C15 & mask) >> 48]

    def slow(text):
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
        each = [float(np.mean([model["scores"][b] for b in buckets(w)])) for w in words]
        cut = [sum(each[i : i + toxicity.SEGMENT]) / toxicity.SEGMENT - 1.0 for i in range(0, len(each), toxicity.SEGMENT)]
        return 1 / (1 + np.exp(-max(cut, default=-1.0)))

    texts = [None, "", "?!", "one", "One two TWO two three, four: five six seven", "Ünïcode straße é1 2x " * 9, "a b " * 40 + "zzgrunk"]
    assert np.allclose(toxicity.score_column(model, pa.array(texts)), [slow(t) for t in texts], atol=1e-5)


def test_models_pass_clashing_columns_and_very_long_texts(spark):
    docs, labels, _, _ = corpus(spark, 120)
    long = spark.createDataFrame([(900, "ba be " * 200_000, "x", "y", "z"), (901, None, None, None, None)], "doc_id long, text string, lang_pred string, score string, toxic_score string")
    model = language_id.fit(docs.unionByName(long.selectExpr("doc_id", "text", "'aa' AS lang", "'s' AS source", "1D AS score")))
    got = {r.doc_id: r for r in language_id.identify(long, model).collect()}
    assert (got[900].lang_pred, got[901].lang_pred, got[901].score, got[900].toxic_score) == ("aa", "und", 0.0, "z")
    scored = {r.doc_id: r for r in toxicity.score(long, toxicity.fit(docs, labels, steps=20)).collect()}
    assert 0 <= scored[900].toxic_score <= 1 and scored[900].lang_pred == "x"
