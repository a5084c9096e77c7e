"""Quality scores by co-training of a text view and a page-metadata view.

The text view sees the whole text and nothing else: hashed byte trigrams, sizes
of lines and words, shares of kinds of bytes.
The page view never sees the text: it has the page's record, that is source,
language tag, the size it was crawled with, and source and language together.
Both start from labelled documents; in each round each view labels the
documents of the whole corpus that it is most confident about, in the
proportion of the classes, for the other. Confidence is calibrated (Platt) on
labelled documents that no view is trained on. A view is sure where its odds
reach the best tenth of these on either side, so each one teaches what it knows
best; what a label counts for is its calibrated margin (2p - 1), so a view that
knows little teaches as many documents, but lightly. At the end the views'
calibrated log-odds are averaged.

Executors make features and, in each round, score all unlabelled documents; a
view's most confident ones are found by a bounded sort (EXCHANGED a round), so
what the driver trains on is bounded: labelled documents (SAMPLE) and those
exchanged. Every whole document is scored.

Defined results: null and empty texts have zero text features; null source,
lang and n_chars (or tables without them) are values of their own; without labels of both kinds all scores are 0.5;
repeated rows score alike; extra columns pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import binary_array, pieces, tidy, utf8_bytes
from citeloom.llm.sampling import sampled_keys
from citeloom.session import written

BUCKETS, HASHED = 2048, 24
#: Labelled documents at most; rounds, documents a view labels in a round, gradient steps.
SAMPLE, ROUNDS, EXCHANGED, STEPS = 2_500, 2, 400, 150
#: The share of calibration rows, on either side, whose odds make a view sure.
SURE = 0.1
#: Kinds of bytes: letters in either case, digits, space, line ends, stops, other ASCII, beyond ASCII.
KINDS = np.full(256, 6, np.int8)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[32], KINDS[10], KINDS[128:] = 0, 1, 2, 3, 4, 7
KINDS[[33, 44, 46, 58, 59, 63]] = 5
N_TEXT = BUCKETS + 13
#: Values of source, of lang and of both together (hashed), and of the size in powers of two.
SIZES = 24
N_PAGE = 2 * HASHED + 4 * HASHED + SIZES


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring positions."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text its size, shares of kinds of bytes and of repeated bytes, sizes of lines and words."""
    n = np.diff(at)
    safe = np.maximum(n, 1)
    kind, lines, words = KINDS[raw], _sums(raw == 10, at) + 1, _sums(raw == 32, at) + 1
    same = np.append(False, raw[1:] == raw[:-1])[: len(raw)]
    columns = [np.log1p(n) / 10, *(_sums(kind == k, at) / safe for k in range(8)), np.log1p(lines) / 5, np.log1p(n / lines) / 10, n / words / 20, _sums(same, at) / safe]
    return np.stack(columns, axis=1).astype(np.float32)


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Buckets of the trigram at each byte but the last two."""
    x = raw.astype(np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:] if len(x) > 2 else np.zeros(0, np.uint32)
    return (code * np.uint32(2654435761) >> np.uint32(21)).astype(np.int16)


def _inside(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which trigrams lie in one text."""
    ok = np.ones(max(0, len(raw) - 2), bool)
    for back in (1, 2):
        edge = at[1:-1] - back
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    return ok


def page_features(batch: pa.RecordBatch) -> np.ndarray:
    """One row of page features for each document: what its record says, without its text."""
    n = batch.num_rows
    of = lambda name: batch.column(name).to_pylist() if name in batch.schema.names else [None] * n
    bucket = lambda value, size: zlib.crc32(repr(value).encode()) % size
    out, row = np.zeros((n, N_PAGE), np.float32), np.arange(n)
    source, lang = of("source"), of("lang")
    known = {pair: (bucket(pair[0], HASHED), HASHED + bucket(pair[1], HASHED), 2 * HASHED + bucket(pair, 4 * HASHED)) for pair in set(zip(source, lang, strict=True))}
    for columns in np.array([known[pair] for pair in zip(source, lang, strict=True)], np.int64).reshape(n, 3).T:
        out[row, columns] = 1
    out[row, 6 * HASHED + np.array([0 if v is None else min(SIZES - 1, 1 + int(v).bit_length()) for v in of("n_chars")], np.int64)] = 1
    return out


def text_features(column: pa.Array) -> np.ndarray:
    """One row of square-rooted trigram shares and of statistics for each document."""
    raw, at = utf8_bytes(column)
    n, gram, ok = len(column), trigrams(raw).astype(np.int64), _inside(raw, at)
    row = np.repeat(np.arange(n), np.diff(at))[: len(gram)]
    counts = np.bincount(row[ok] * BUCKETS + gram[ok], minlength=n * BUCKETS).reshape(n, BUCKETS)
    shares = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    return np.concatenate([shares, statistics(raw, at)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS, decay: float = 1e-4, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one is the bias) of a class-balanced logistic regression, by Adam; weight: what each row counts for."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight = np.ones(len(y)) if weight is None else weight
    share = (weight * np.where(y == 1, 0.5 / max(1e-9, weight[y == 1].sum()), 0.5 / max(1e-9, weight[y == 0].sum()))).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        g = ((1 / (1 + np.exp(-(x @ w))) - y) * share) @ x + decay * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's logits into log-odds."""
    scale = max(1e-6, float(np.abs(logit).mean()))
    a, b = logistic((logit / scale)[:, None].astype(np.float32), y, 300, 1e-3)
    return max(1e-3, float(a)) / scale, float(b)


def split_known(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to learn from and rows for calibration."""
    rows = np.arange(len(y))
    aside = rows[::5]
    base = np.setdiff1d(rows, aside)
    if len(np.unique(y[base])) < 2 or len(np.unique(y[aside])) < 2:
        return rows, rows
    return base, aside


def co_train(views: list[np.ndarray], y: np.ndarray, exchange, rounds: int = ROUNDS) -> list[dict]:
    """Weights and calibration of both views, learnt from labelled rows (features of each view, and y).

    exchange(models, share) names what each view is most sure about in the
    corpus: for each view the other view's features of those documents, the
    labels it gives them and, if it likes, what each counts for. A document is
    labelled once at most. Each model says how many labels it was taught
    (taught), and from which odds on it is sure (sure: low and high).
    """
    base, aside = split_known(y)
    x, taught = [v[base] for v in views], [y[base], y[base]]
    counts = [np.ones(len(base)), np.ones(len(base))]
    share = float((y[base] == 1).mean())

    def learnt() -> list[dict]:
        out = []
        for view, own, labels, weight in zip(views, x, taught, counts, strict=True):
            w = logistic(own, labels, weight=weight)
            logit = view[aside] @ w[:-1] + w[-1]
            a, b = platt(logit, y[aside])
            low, high = np.quantile(a * logit + b, [SURE, 1 - SURE], method="lower")
            out.append({"w": w, "a": a, "b": b, "sure": (min(low, -1e-6), max(high, 1e-6)), "taught": len(labels) - len(base)})
        return out

    models = learnt()
    for _ in range(rounds):
        for view, (features, labels, *weight) in enumerate(exchange(models, share)):
            other = 1 - view
            if len(labels):
                counts[other] = np.concatenate([counts[other], weight[0] if weight else np.ones(len(labels))])
                x[other] = np.concatenate([x[other], features])
                taught[other] = np.concatenate([taught[other], labels])
        models = learnt()
    return models


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


RECORD = ("source", "lang", "n_chars")


def _with_record(docs: DataFrame) -> DataFrame:
    """doc_id, text and the columns of the page's record; those that docs lacks are null."""
    return docs.select("doc_id", "text", *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in RECORD])


def sampled_features(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, text_view, page_view (binary) of the documents with these keys (a bounded number)."""
    rows = _with_record(docs).join(F.broadcast(keys), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *RECORD)).alias("r")).select("doc_id", "r.*")

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            for i in range(0, batch.num_rows, 500):
                own = batch.slice(i, 500)
                text, page = text_features(own.column("text")), page_features(own)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *(binary_array(v, np.full(len(v), v.shape[1] * 4)) for v in (text, page))], names=["doc_id", "text_view", "page_view"])

    return rows.mapInArrow(tidy(run), "doc_id long, text_view binary, page_view binary")


def _collected(docs: DataFrame, ids: list[int]) -> tuple[list[int], list[np.ndarray]]:
    """The ids found and both views' features, in the order of ids."""
    keys = docs.sparkSession.createDataFrame([(k,) for k in ids], "doc_id long")
    rows = sampled_features(docs, keys).orderBy("doc_id").collect()
    views = [np.stack([np.frombuffer(r[k], np.float32) for r in rows]) if rows else np.zeros((0, n), np.float32) for k, n in (("text_view", N_TEXT), ("page_view", N_PAGE))]
    return [r["doc_id"] for r in rows], views


def view_logits(batch: pa.RecordBatch, weights: list[np.ndarray]) -> np.ndarray:
    """The logits of both views for every document of a batch."""
    n, w = batch.num_rows, weights[0]
    raw, at = utf8_bytes(batch.column("text"))
    # The square root keeps the sum from being linear in the bytes: count each text's trigrams.
    gram, ok = trigrams(raw).astype(np.int64), _inside(raw, at)
    row = np.repeat(np.arange(n), np.diff(at))[: len(gram)]
    key, count = np.unique(row[ok] * BUCKETS + gram[ok], return_counts=True)
    doc = key // BUCKETS
    total = np.maximum(np.bincount(row[ok], minlength=n), 1)
    odds = np.zeros((2, n))
    odds[0] = np.bincount(doc, np.sqrt(count / total[doc]) * w[key % BUCKETS], n) + statistics(raw, at) @ w[BUCKETS:-1] + w[-1]
    odds[1] = page_features(batch) @ weights[1][:-1] + weights[1][-1]
    return odds


def log_odds(batch: pa.RecordBatch, models: list[dict]) -> np.ndarray:
    """The calibrated log-odds of both views."""
    slope, offset = (np.array([[m[k]] for m in models]) for k in "ab")
    return view_logits(batch, [m["w"] for m in models]) * slope + offset


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> list[dict] | None:
    """Both views' models from labels outside the held-out third and from the unlabelled documents."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    few = [sampled_keys(marks.filter(F.col("quality") == k), "doc_id", sample * (1 + k) // 3) for k in (0, 1)]
    truth = {r["doc_id"]: k for k in (0, 1) for r in few[k].collect()}
    ids, views = _collected(docs, list(truth))
    y = np.array([truth[i] for i in ids], np.int64)
    if len(np.unique(y)) < 2:
        return None
    marked = labels.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    free = _with_record(docs).filter("doc_id IS NOT NULL").filter(~held_out())
    used: set[int] = set()

    def exchange(models, share):
        def run(batches):
            for batch in pieces(batches, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, log_odds(batch, models))], names=["doc_id", "text_logit", "page_logit"])

        scored = free.mapInArrow(tidy(run), "doc_id long, text_logit double, page_logit double")
        logits = written(scored.join(marked, "doc_id", "left_anti"), "logits")
        picked = []
        for name, model in zip(("text_logit", "page_logit"), models, strict=True):
            # Bounded sorts: every task sends its best rows only. Some more, as others may have been used.
            low, high = model["sure"]
            best = {1: logits.filter(F.col(name) >= float(high)).orderBy(F.desc(name), F.xxhash64("doc_id"), "doc_id"), 0: logits.filter(F.col(name) <= float(low)).orderBy(F.asc(name), F.xxhash64("doc_id"), "doc_id")}
            found = {}
            for label, part in ((1, share), (0, 1 - share)):
                size = max(1, round(exchanged * part))
                rows = best[label].select("doc_id", name).limit(size + len(used) + exchanged).collect()
                fresh = {r["doc_id"]: r[name] for r in rows if r["doc_id"] not in used and r["doc_id"] not in found}
                found |= {i: (label, odds) for i, odds in list(fresh.items())[:size]}
            # As many of either kind as keep the proportion of the classes.
            have = {k: sum(1 for label, _ in found.values() if label == k) for k in (0, 1)}
            total = min(have[1] / max(share, 1e-9), have[0] / max(1 - share, 1e-9))
            own, left = {}, {1: round(total * share), 0: round(total * (1 - share))}
            for i, (label, odds) in found.items():
                if left[label]:
                    own[i], left[label] = (label, float(np.tanh(abs(odds) / 2))), left[label] - 1
            used.update(own)
            picked.append(own)
        found, features = _collected(docs, [*picked[0], *picked[1]])
        out = []
        for view, own in enumerate(picked):
            at = [i for i, k in enumerate(found) if k in own]
            given = [own[found[i]] for i in at]
            out.append((features[1 - view][at], np.array([g[0] for g in given], np.int64), np.array([g[1] for g in given])))
        return out

    return co_train(views, y, exchange, rounds)


def score(docs: DataFrame, models: list[dict] | None) -> DataFrame:
    """docs with text_score, page_score and quality_score."""
    new = ("text_score", "page_score", "quality_score")
    keep = [c for c in docs.columns if c not in new]
    schema = docs.select(*keep).schema
    for name in new:
        schema = schema.add(name, "double")

    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            odds = log_odds(batch, models) if models else np.zeros((2, batch.num_rows))
            each = [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (odds[0], odds[1], odds.mean(axis=0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *map(pa.array, each)], names=[*keep, *new])

    return docs.select(*keep).mapInArrow(tidy(run), schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document, and what either view says."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text", *RECORD), fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
        "text_score",
        "page_score",
    )
