"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the
word itself (hashed to BUCKETS), so a misspelling shares most of what its word has learnt. Words
are averaged over segments of SEGMENT words (places a short one lacks count as
zero) and go to a linear softmax; a
document is as toxic as its worst segment, so a long clean text does not hide
an insult. Training sees documents' labels only: the gradient flows through
the segments in proportion to how much they decide their document.

As everything between a word and its segment's logit is linear, scoring needs
one number for each n-gram bucket. Arrow cuts the words of a batch and makes
them distinct; numpy hashes their n-grams.

Defined results: a null text is empty; a text without letters or digits has
the score of a segment without words (the bias); without labelled rows of
both kinds (of LONGEST bytes or less) all scores are 0; repeated rows score alike; extra columns pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import compact_text, pieces, release, tidy, utf8_bytes
from citeloom.llm.sampling import sampled_keys

BUCKETS, DIM, SEGMENT, GRAMS = 1 << 16, 8, 6, (3, 4, 5)
#: Clean and toxic labelled documents to learn from at most, and the bytes of the longest of them.
SAMPLE, LONGEST = (4_000, 2_000), 32_768
#: Training steps, documents of a step, and weight decay.
STEPS, BATCH, DECAY = 240, 128, 1e-5
SIT_OUT = 0.3
#: A document's score from which it counts as toxic.
THRESHOLD = 0.7


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the distinct words, and the number of words of each row.

    A word that repeats at once counts once.
    """
    text = pc.replace_substring_regex(pc.utf8_lower(compact_text(column)), r"[^\pL\pN]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    coded = lists.flatten().dictionary_encode()
    per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, row = coded.indices.to_numpy(), np.repeat(np.arange(len(per)), per)
    again = np.append(False, (codes[1:] == codes[:-1]) & (row[1:] == row[:-1]))[: len(codes)]
    again |= pc.equal(coded, "").to_numpy(zero_copy_only=False).astype(bool)  # a text without words splits into an empty one
    return codes[~again], coded.dictionary, per - np.bincount(row[again], minlength=len(per))


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of <word> and of the whole, word after word, and how many each word has."""
    raw, at = utf8_bytes(words)
    n = np.diff(at) + 2
    end = np.cumsum(n)
    marked = np.full(int(end[-1]) if len(end) else 0, ord("<"), np.uint64)
    marked[end - 1] = ord(">")
    inner = np.ones(len(marked), bool)
    inner[end - 1] = inner[end - n] = False
    marked[inner] = raw
    left = np.repeat(end, n) - np.arange(len(marked))  # bytes from here to the word's end
    word = np.repeat(np.arange(len(n), dtype=np.int32), n)
    buckets, owner = [], []
    h = np.full(len(marked), 1469598103934665603, np.uint64)
    for size in range(1, max(GRAMS) + 1):
        part = marked[size - 1 :]
        h = (h[: len(part)] ^ part) * np.uint64(1099511628211)
        if size in GRAMS:
            fits = left[: len(h)] >= size
            mixed = h[fits] * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(48)).astype(np.int32) % BUCKETS)
            owner.append(word[: len(h)][fits])
    if len(n):  # and the whole word
        power = np.multiply.accumulate(np.full(int(n.max()), 0x100000001B3, np.uint64))
        whole = np.add.reduceat(marked * power[np.repeat(n, n) - left], end - n) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((whole >> np.uint64(48)).astype(np.int32) % BUCKETS)
        owner.append(np.arange(len(n), dtype=np.int32))
    owners, all_buckets = np.concatenate(owner), np.concatenate(buckets)
    counts = np.bincount(owners, minlength=len(n))
    return all_buckets[np.argsort(owners, kind="stable")], counts


def segments_of(per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all segments, and the number of segments of each row (0 without words)."""
    count = -(-per // SEGMENT)
    first = np.cumsum(per) - per
    row = np.repeat(np.arange(len(per)), count)
    return first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT, count


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, first[1] .. and so on."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(first - (end - size), size)


def train(texts: list[str], toxic: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 3) -> dict:
    """The score of every bucket and the bias, learnt from documents and their labels.

    Each step takes batch / 2 documents of either label and follows the
    gradient through all their words and n-grams (Adam).
    """
    rng = np.random.default_rng(seed)
    codes, words, per = words_of(pa.array(texts, pa.string()))
    parts = [grams_of(words.slice(i, 50_000)) for i in range(0, len(words), 50_000)]
    buckets, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
    gram_at, word_at = np.cumsum(grams) - grams, np.cumsum(per) - per
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype("f4")
    out = rng.normal(0, 0.5, (DIM, 2)).astype("f4")
    bias = np.zeros(2, "f4")
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, out, bias)]
    kinds = [np.flatnonzero((toxic == k) & (per > 0)) for k in (0, 1)]
    queues: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
    for step in range(1, steps + 1):
        own = []
        for k in (0, 1):
            while len(queues[k]) < batch // 2:
                queues[k] = np.concatenate([queues[k], rng.permutation(kinds[k])])
            own.append(queues[k][: batch // 2])
            queues[k] = queues[k][batch // 2 :]
        docs = np.concatenate(own)
        here, code = np.unique(codes[_ranges(word_at[docs], per[docs])], return_inverse=True)
        n_grams = grams[here]
        bucket = buckets[_ranges(gram_at[here], n_grams)]
        word_of_gram = np.repeat(np.arange(len(here)), n_grams)
        n_grams = np.maximum(n_grams, 1)
        first, count = segments_of(per[docs])
        size = np.diff(np.append(first, len(code)))
        segment, doc, doc_at = np.repeat(np.arange(len(first)), size), np.repeat(np.arange(len(docs)), count), np.cumsum(count) - count
        vectors = np.stack([np.bincount(word_of_gram, emb[bucket, k], len(here)) for k in range(DIM)], axis=1) / n_grams[:, None]
        mean = np.add.reduceat(vectors[code], first, axis=0) / SEGMENT
        both = mean @ out + bias
        logit = both[:, 1] - both[:, 0]
        # Documents: a soft maximum of their segments, harder as training goes on. At first some
        # segments sit out at random, so that one insult does not spare the model from learning the others.
        heat = 0.7 + 3 * (step / steps) ** 2
        out_of_play = rng.random(len(logit)) < SIT_OUT * (step < 0.85 * steps)
        out_of_play[doc_at] = False
        logit = np.where(out_of_play, -30.0, logit)
        top = np.maximum.reduceat(logit, doc_at)
        e = np.exp(heat * (logit - top[doc]))
        total = np.add.reduceat(e, doc_at)
        level = top + np.log(total / count) / heat * (1 - step / steps)
        error = (1 / (1 + np.exp(-level)) - toxic[docs]) / len(docs)
        dlogit = error[doc] * e / total[doc]
        dboth = np.stack([-dlogit, dlogit], axis=1)
        dmean = (dboth @ out.T) / SEGMENT
        dword = np.stack([np.bincount(code, dmean[segment, k], len(here)) for k in range(DIM)], axis=1) / n_grams[:, None]
        demb = np.stack([np.bincount(bucket, dword[word_of_gram, k], BUCKETS) for k in range(DIM)], axis=1)
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        for (m, v), g, x in zip(state, (demb + DECAY * emb, mean.T @ dboth, dboth.sum(axis=0)), (emb, out, bias), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    side = out[:, 1] - out[:, 0]
    return {"scores": (emb @ side).astype("f4"), "bias": float(bias[1] - bias[0])}


def score_column(model: dict, column: pa.Array) -> np.ndarray:
    """Scores of the texts of an Arrow column."""
    codes, words, per = words_of(column)
    logits = np.full(len(per), model["bias"], np.float64)
    if len(codes):
        buckets, grams = grams_of(words)
        word = np.bincount(np.repeat(np.arange(len(grams)), grams), model["scores"][buckets], len(grams)) / np.maximum(grams, 1)
        first, count = segments_of(per)
        segment = np.add.reduceat(word[codes], first) / SEGMENT + model["bias"]
        some = count > 0
        logits[some] = np.maximum.reduceat(segment, (np.cumsum(count) - count)[some])
    return 1 / (1 + np.exp(-logits))


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, steps: int = STEPS) -> dict | None:
    """A model from at most `sample` clean and toxic documents outside the held-out third, of LONGEST bytes at most.

    So the driver never gets more than that many bytes. Labels that contradict one another for a document are left out.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    docs, found = docs.filter(F.octet_length("text") <= LONGEST), []
    for toxic in (0, 1):
        keys = F.broadcast(sampled_keys(marks.filter(F.col("toxic") == toxic), "doc_id", sample[toxic]))  # at most that many longs
        rows = docs.join(keys, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        found += rows.orderBy("doc_id").select("text", F.lit(toxic).alias("toxic")).collect()
    if len({r["toxic"] for r in found}) < 2:
        return None
    model = train([r["text"] for r in found], np.array([r["toxic"] for r in found]), steps)
    del found
    release()
    return model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with toxic_score."""
    keep = [c for c in docs.columns if c != "toxic_score"]
    schema = docs.select(*keep).schema.add("toxic_score", "double")

    def run(batches):
        for batch in pieces(batches, "text", 3 << 20):
            scores = score_column(model, batch.column("text")) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(scores)], names=[*keep, "toxic_score"])

    return docs.select(*keep).mapInArrow(tidy(run), schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
