"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Two recurrent passes of HIDDEN units read a text's bytes in windows of STEPS; at every byte a softmax over both states
gives the probabilities of all languages, and a document's probabilities are the means over all of its bytes.
Everything runs with the windows as the last axis, so each step is a few vector operations over thousands of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table, text_chunks

HIDDEN, STEPS = 8, 64
#: Documents that a fit is given, about the same number of each language but at least FIT_EACH, whole ones chosen by a hash of their id.
#: Longer ones than FIT_CHARS aren't chosen (they are judged like all others), so that the driver holds a bounded sample.
FIT_DOCUMENTS, FIT_EACH, FIT_CHARS = 3000, 20, 20_000
ROUNDS, BATCH, RATE = 400, 192, 0.02
#: Windows that one numpy pass holds.
WINDOWS = 4096


def init(languages: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), HIDDEN
    p = {"V": rng.normal(0, 0.3, (languages, 2 * h)), "c": np.zeros((languages, 1))}
    for d in "fb":
        p["W" + d] = rng.normal(0, 0.3, (3 * h, 256))
        p["U" + d] = rng.normal(0, 0.3, (3 * h, h))
        p["a" + d] = np.zeros((3 * h, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _states(p: dict[str, np.ndarray], d: str, x: np.ndarray, keep: list | None) -> np.ndarray:
    """States [step, unit, window] of one direction for bytes x [step, window]; keep gets what backpropagation needs."""
    h, (steps, n) = HIDDEN, x.shape
    # sigmoid(v) = (1 + tanh(v / 2)) / 2, so the gates' rows are halved once and one tanh serves all.
    half = np.ones((3 * h, 1), np.float32)
    half[: 2 * h] = 0.5
    w, u = np.ascontiguousarray(((p["W" + d] + p["a" + d]) * half).T), p["U" + d] * half
    s, out = np.zeros((h, n), np.float32), np.empty((steps, h, n), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        i = w[x[t]].T
        g = u @ s
        zr = np.tanh(i[: 2 * h] + g[: 2 * h])
        zr += 1
        zr *= 0.5
        z, r = zr[:h], zr[h:]
        m = g[2 * h :]
        c = m * r
        c += i[2 * h :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((t, s, z, r, m, c))
        new = s - c
        new *= z
        new += c
        s = out[t] = new
    return out


def _softmax(v: np.ndarray) -> np.ndarray:
    v -= v.max(axis=-2, keepdims=True)
    np.exp(v, out=v)
    v /= v.sum(axis=-2, keepdims=True)
    return v


def probabilities(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """[step, language, window] for bytes x [step, window]."""
    h = HIDDEN
    return _softmax(p["V"][:, :h] @ _states(p, "f", x, None) + p["V"][:, h:] @ _states(p, "b", x, None) + p["c"])


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions and its gradients; y is the language of each window."""
    h, (steps, n) = HIDDEN, x.shape
    kept: dict[str, list] = {"f": [], "b": []}
    both = np.concatenate([_states(p, d, x, kept[d]) for d in "fb"], axis=1)
    prob = _softmax(p["V"] @ both + p["c"])
    loss = -float(np.log(prob[:, y, np.arange(n)] + 1e-9).mean())
    prob[:, y, np.arange(n)] -= 1
    prob /= steps * n
    g = {"V": np.einsum("tln,thn->lh", prob, both), "c": prob.sum(axis=(0, 2))[:, None]}
    back = p["V"].T @ prob
    for k, d in enumerate("fb"):
        u = p["U" + d]
        gw, gu, ds = np.zeros_like(p["W" + d]), np.zeros_like(u), np.zeros((h, n), np.float32)
        for t, s, z, r, m, c in reversed(kept[d]):
            ds = ds + back[t, k * h : (k + 1) * h]
            dc = ds * (1 - z) * (1 - c * c)
            dz = ds * (s - c) * z * (1 - z)
            dr = dc * m * r * (1 - r)
            gate = np.concatenate([dz, dr, dc * r])
            gu += gate @ s.T
            enter = np.concatenate([dz, dr, dc])
            np.add.at(gw.T, x[t], enter.T)
            ds = ds * z + u.T @ gate
        g["U" + d], g["W" + d], g["a" + d] = gu, gw, gw.sum(axis=1, keepdims=True)
    return loss, g


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def fit(rows: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 0) -> Model:
    """Train on (text, language) with Adam; each step takes BATCH windows, a language as often as any other."""
    languages = sorted({lang for _, lang in rows})
    p = init(max(1, len(languages)), seed)
    texts = {lang: [b for t, own in rows if own == lang and (b := np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)).size] for lang in languages}
    use = [i for i, lang in enumerate(languages) if texts[lang]]
    if len(use) < 2:
        return Model(languages, p)
    rng = np.random.default_rng(seed)
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    for step in range(1, rounds + 1):
        y = rng.choice(use, BATCH)
        x = np.full((STEPS, BATCH), 32, np.uint8)
        for j, i in enumerate(y):
            own = texts[languages[i]]
            b = own[rng.integers(len(own))]
            a = rng.integers(max(1, len(b) - STEPS + 1))
            piece = b[a : a + STEPS]
            x[: len(piece), j] = piece
        _, g = gradients(p, x, y)
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.001 * (g[k] * g[k] - v[k])
            rate = RATE * (1 - step / (rounds + 1))
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, p)


def predict(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and its mean probability for each text: und and 0 for a null text or one without a letter, or without a learned language."""
    names, scores = [], []
    heard = [any(map(str.isalpha, t)) if t else False for t in texts.to_pylist()]
    if not model.languages:
        return ["und"] * len(heard), [0.0] * len(heard)
    done = 0
    for _, n, data, offsets in text_chunks(texts):
        size = np.diff(offsets)
        count = -(-size // STEPS)
        first = np.concatenate([[0], np.cumsum(count)])
        total = np.zeros((int(first[-1]), len(model.languages)))
        doc = np.repeat(np.arange(n), count)
        start = offsets[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc]) * STEPS
        length = np.minimum(offsets[1:][doc] - start, STEPS)
        padded = np.concatenate([data, np.full(STEPS, 32, np.uint8)])
        for a in range(0, len(start), WINDOWS):
            at, own = start[a : a + WINDOWS], length[a : a + WINDOWS]
            x = padded[at[None, :] + np.arange(STEPS)[:, None]]
            inside = np.arange(STEPS)[:, None] < own
            x[~inside] = 32
            p = probabilities(model.weights, x)
            short = np.flatnonzero(own < STEPS)
            p[:, :, short] *= inside[:, None, short]
            total[a : a + WINDOWS] = p.sum(axis=0).T
        ends = first[1:]
        sums = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(total, axis=0)])
        mean = (sums[ends] - sums[first[:-1]]) / np.maximum(size, 1)[:, None]
        best = mean.argmax(axis=1)
        for i in range(n):
            ok = heard[done + i]
            names.append(model.languages[best[i]] if ok else "und")
            scores.append(float(min(1.0, max(0.0, mean[i, best[i]]))) if ok else 0.0)
        done += n
    return names, scores


def fit_shares(counts: dict[str, int]) -> dict[str, float]:
    """The share of each language's documents that a fit is given: a double, so that it is above 0 for any number of documents."""
    each = max(FIT_EACH, FIT_DOCUMENTS // max(1, len(counts)))
    return {lang: min(1.0, each / n) for lang, n in counts.items()}


def fit_on(docs: DataFrame) -> Model:
    """Fit on documents with a text and a lang whose crc32(doc_id) mod 4 is not 2; every language among them is learned."""
    own = docs.where(f"lang is not null and length(text) <= {FIT_CHARS}").where(crc_mod("doc_id", 4) != 2)
    shares = fit_shares({r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()})
    if not shares:
        return Model([], init(1))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sorted(shares.items()), "l string, share double"))  # one row for each language
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    some = own.join(wanted, F.col("lang") == F.col("l")).where(place < F.col("share"))
    rows = some.select("doc_id", "text", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * max(FIT_DOCUMENTS, FIT_EACH * len(shares))).collect()
    return fit([(r.text, r.lang) for r in rows])


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) without text and with lang_pred, score more.

    A null text and one without a letter is und with score 0; of equally likely languages the first by name is taken.
    Repeated rows are judged each on its own, an empty table gives an empty one,
    and whole texts of any length are read. Columns of docs called lang_pred or score are replaced.
    """
    from pyspark.sql import types as T

    own = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    schema = T.StructType([*own, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = predict(model, b.column("text"))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in own], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*[f.name for f in own], "text").mapInArrow(run, schema)


def language_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_on(docs)
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
