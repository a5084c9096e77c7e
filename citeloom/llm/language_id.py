"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes forwards and backwards and labels every
position; a document's probabilities are the mean over all its positions.
It is trained in numpy by backpropagation through time on windows of a bounded
sample of labelled documents (SAMPLE documents, CUT windows of SPAN bytes from
all over each); every byte of every document is scored. Scoring
advances thousands of windows in step, so each numpy call does much work.

Defined results: a text that is null or has no letter is `und` with score 0;
without any labelled row every text is `und`; repeated rows are scored alike;
extra columns pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import pieces, release, tidy, utf8_bytes
from citeloom.llm.sampling import sampled_keys

HIDDEN, WINDOW, LANES = 8, 128, 2048
#: Labelled documents to learn from, and windows of each that executors cut out.
SAMPLE, CUT = 3_000, 8
#: Training steps, windows of a step and their bytes.
STEPS, BATCH, SPAN = 260, 192, 48


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def new_model(languages: list[str], seed: int = 1) -> dict:
    """Weights of both directions: byte table, recurrent matrix, and the output layer."""
    rng = np.random.default_rng(seed)
    h, n = HIDDEN, len(languages)
    one = lambda: {"table": rng.normal(0, 0.4, (256, 3 * h)).astype("f4"), "u": rng.normal(0, 0.35, (3 * h, h)).astype("f4"), "w": rng.normal(0, 0.3, (n, h)).astype("f4")}
    return {"languages": languages, "f": one(), "b": one(), "bias": np.zeros((n, 1), "f4")}


def run_direction(side: dict, steps: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
    """States after each step of bytes (steps: time x lanes); keep collects what training needs."""
    h, states = np.zeros((HIDDEN, steps.shape[1]), "f4"), []
    for now in steps:
        x = side["table"][now].T
        a = side["u"][: 2 * HIDDEN] @ h
        a += x[: 2 * HIDDEN]
        gates = _sigmoid(a)
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        rh = r * h
        c = side["u"][2 * HIDDEN :] @ rh
        c += x[2 * HIDDEN :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((h, z, r, rh, c))
        h = c + z * (h - c)
        states.append(h)
    return states


def gradients(model: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """The mean loss of all positions of windows x (time x lanes) in languages y, and its gradients by weight."""
    lanes = np.arange(len(y))
    cache: dict[str, list] = {"f": [], "b": []}
    hf = np.stack(run_direction(model["f"], x, cache["f"]))
    hb = np.stack(run_direction(model["b"], x[::-1], cache["b"])[::-1])
    logits = model["f"]["w"] @ hf + model["b"]["w"] @ hb + model["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(p[:, y, lanes]).mean())
    p[:, y, lanes] -= 1
    p /= p.shape[0] * len(y)
    grads = {("f", "w"): np.einsum("tln,thn->lh", p, hf), ("b", "w"): np.einsum("tln,thn->lh", p, hb), "bias": p.sum(axis=(0, 2))[:, None]}
    for side in "fb":
        s = model[side]
        out = s["w"].T @ (p if side == "f" else p[::-1])
        seq = x if side == "f" else x[::-1]
        table, u, dh = np.zeros_like(s["table"]), np.zeros_like(s["u"]), np.zeros((HIDDEN, len(y)), "f4")
        for t in reversed(range(len(x))):
            h, z, r, rh, c = cache[side][t]
            d = out[t] + dh
            dc = d * (1 - z) * (1 - c * c)
            drh = s["u"][2 * HIDDEN :].T @ dc
            dz, dr = d * (h - c) * z * (1 - z), drh * h * r * (1 - r)
            gates = np.concatenate([dz, dr])
            dh = d * z + drh * r + s["u"][: 2 * HIDDEN].T @ gates
            u[: 2 * HIDDEN] += gates @ h.T
            u[2 * HIDDEN :] += dc @ rh.T
            np.add.at(table, seq[t], np.concatenate([gates, dc]).T)
        grads |= {(side, "table"): table, (side, "u"): u}
    return loss, grads


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 1) -> dict:
    """windows: n x SPAN bytes, labels: n numbers. Adam on the mean loss of all positions."""
    model, rng = new_model(languages, seed), np.random.default_rng(seed)
    weights = {(s, k): model[s][k] for s in "fb" for k in ("table", "u", "w")} | {"bias": model["bias"]}
    moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in weights.items()}
    share = np.bincount(labels, minlength=len(languages)).astype("f8")
    chance = 1 / share[labels]
    chance /= chance.sum()
    for step in range(1, steps + 1):
        pick = rng.choice(len(windows), BATCH, p=chance)
        _, grads = gradients(model, windows[pick].T, labels[pick])
        rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
        for k, w in weights.items():
            m, v = moments[k]
            m += 0.1 * (grads[k] - m)
            v += 0.01 * (grads[k] * grads[k] - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return model


def position_scores(side: dict, steps: np.ndarray) -> np.ndarray:
    """What a direction adds to the language scores after each step: time x languages x lanes.

    The same recurrence as run_direction, with signs and the factor 2 of
    tanh(c) = 1 - 2 / (1 + exp(2 c)) moved into the weights and every
    intermediate result in one place.
    """
    scale = np.repeat(np.array([-1, 2], "f4"), [2 * HIDDEN, HIDDEN])
    table, u = np.ascontiguousarray((side["table"] * scale).T), side["u"] * scale[:, None]
    n = steps.shape[1]
    x, a, c, rh = (np.empty((k * HIDDEN, n), "f4") for k in (3, 2, 1, 1))
    h, states = np.zeros((HIDDEN, n), "f4"), np.empty((len(steps), HIDDEN, n), "f4")
    for out, now in zip(states, steps, strict=True):
        np.take(table, now, axis=1, out=x, mode="clip")
        np.matmul(u[: 2 * HIDDEN], h, out=a)
        a += x[: 2 * HIDDEN]
        np.exp(a, out=a)
        a += 1
        np.reciprocal(a, out=a)
        np.multiply(a[HIDDEN:], h, out=rh)
        np.matmul(u[2 * HIDDEN :], rh, out=c)
        c += x[2 * HIDDEN :]
        np.exp(c, out=c)
        c += 1
        np.reciprocal(c, out=c)
        c *= -2
        c += 1
        np.subtract(h, c, out=out)
        out *= a[:HIDDEN]
        out += c
        h = out
    return side["w"] @ states


def window_probabilities(model: dict, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums over a window's positions of each language's probability. All windows of one call run in step."""
    span = int(size.max())
    t = np.arange(span)[:, None]
    full = bool((size == span).all())
    p = position_scores(model["f"], raw[start + np.minimum(t, size - 1)])
    back = position_scores(model["b"], raw[start + np.maximum(size - 1 - t, 0)])  # at step t for position size - 1 - t
    p += back[::-1] if full else np.take_along_axis(back, np.maximum(size - 1 - t, 0)[:, None, :], axis=0)
    p += model["bias"]
    np.exp(p, out=p)
    each = 1 / p.sum(axis=1)
    if not full:
        each *= t < size
    return np.einsum("tln,tn->ln", p, each)


def position_labels(model: dict, text: str) -> list[str]:
    """The likeliest language at every byte of a text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out: list[str] = []
    for at in range(0, len(raw), WINDOW):
        x = raw[at : at + WINDOW][:, None]
        fw, bw = run_direction(model["f"], x), run_direction(model["b"], x[::-1])[::-1]
        out += [model["languages"][int((model["f"]["w"] @ a + model["b"]["w"] @ b + model["bias"]).argmax())] for a, b in zip(fw, bw, strict=True)]
    return out


def document_probabilities(model: dict, column: pa.Array) -> np.ndarray:
    """Mean probabilities of every text of an Arrow column; null and empty texts have zeros."""
    raw, at = utf8_bytes(column)
    size = np.diff(at)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    start = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    length = np.minimum(WINDOW, at[row + 1] - start)
    order = np.argsort(-length, kind="stable")
    sums = np.zeros((len(row), len(model["languages"])))
    for i in range(0, len(order), LANES):
        own = order[i : i + LANES]
        sums[own] = window_probabilities(model, raw, start[own], length[own]).T
    out = np.zeros((len(size), len(model["languages"])))
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(row, sums[:, k], len(size))
    return out / np.maximum(size, 1)[:, None]


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang and windows (CUT x SPAN bytes) of a bounded sample of documents outside the held-out fifth.

    Executors cut the windows, so that no text goes to the driver. A shorter
    text repeats in its windows.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labelled = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held)
    keys = F.broadcast(sampled_keys(labelled, "doc_id", sample))  # at most `sample` longs
    rows = labelled.filter("text IS NOT NULL AND text != ''").join(keys, "doc_id", "left_semi").select("doc_id", "lang", "text")

    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            raw, at = utf8_bytes(batch.column("text"))
            cut = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                rng = np.random.default_rng(zlib.crc32(raw[a:b]))
                own = [raw[a + i : min(b, a + i + SPAN)] for i in rng.integers(0, max(1, b - a - SPAN + 1), CUT).tolist()]
                cut.append(b"".join(np.resize(x, SPAN).tobytes() for x in own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(cut, pa.binary())], names=["doc_id", "lang", "windows"])

    found = rows.mapInArrow(tidy(run), "doc_id long, lang string, windows binary")
    # Rows that share a doc_id count once.
    return found.groupBy("doc_id").agg(F.min(F.struct("windows", "lang")).alias("r")).orderBy("doc_id").select("r.windows", "r.lang")


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 1) -> dict | None:
    """A model from training_windows, or None if there are none."""
    rows = training_windows(docs, sample).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    windows = np.frombuffer(b"".join(r["windows"] for r in rows), np.uint8).reshape(-1, SPAN)
    labels = np.repeat([languages.index(r["lang"]) for r in rows], CUT)
    model = train(windows, labels, languages, seed=seed)
    release()
    return model


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred and score."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*keep, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if model:
                p = document_probabilities(model, batch.column("text"))
                letter = batch.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
                names[letter] = np.array(model["languages"], object)[p.argmax(axis=1)[letter]]
                scores[letter] = np.clip(p.max(axis=1)[letter], 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = identify(docs.select("doc_id", "text"), fit(docs))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(scored: DataFrame, least: float = 0.35) -> DataFrame:
    """Documents in a language that the model knows, with a score of at least `least`."""
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
