"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is one word written twice between spaces: alone, a short word never compresses, so no dictionary could tell
itself apart on it. Each window is compressed with both dictionaries; the triple (window bytes, bytes with the
ordinary dictionary, bytes with the toxic one) has a log-likelihood ratio calibrated on the labelled documents, and a
document's score comes from its most toxic window against a calibrated threshold.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Labelled documents of each class that a fit reads at most, whole texts, chosen by a hash of their id.
FIT_TOXIC, FIT_ORDINARY = 2500, 5000
#: Longer documents are not chosen for the fit (they are scored like all others).
FIT_CHARS = 1_000_000
DICTIONARY_BYTES, DICTIONARY_WINDOWS, LEVEL = 4096, 60_000, 3
#: Words that a task remembers the outcome of; beyond that it forgets them all.
REMEMBERED = 200_000


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def window(word: bytes) -> bytes:
    return b" " + (word + b" ") * 2


def _compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    p = zstd.ZstdCompressionParameters.from_level(
        LEVEL, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    return zstd.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass
class Model:
    """Fitted dictionaries and calibration; toxic is empty where the labels hold too little of either class, and every score is then 0."""

    toxic: bytes = b""
    ordinary: bytes = b""
    cells: dict[tuple[int, int, int], float] = field(default_factory=dict)
    threshold: float = 0.0

    def scorer(self):
        """A function from a text to its score in [0, 1]."""
        if not self.toxic:
            return lambda text: 0.0
        a, b, cells, known = _compressor(self.ordinary), _compressor(self.toxic), self.cells, {}

        def score(text: str | None) -> float:
            most = -4.0
            for w in set(words(text or "")):
                v = known.get(w)
                if v is None:
                    x = window(w)
                    v = cells.get((len(x), len(a.compress(x)), len(b.compress(x))), 0.0)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = v
                if v > most:
                    most = v
            return 1 / (1 + math.exp(self.threshold - most))

        return score


def _distinct(texts: list[str]) -> list[str]:
    """One text of each group of near copies (those that share their smallest 5-word shingle hash), so that no copied page teaches its own words."""
    from zlib import crc32

    found: dict[int, str] = {}
    for t in texts:
        w = words(t)
        found.setdefault(min((crc32(b" ".join(w[i : i + 5])) for i in range(max(len(w) - 4, 1))), default=0), t)
    return list(found.values())


def _segments(word: bytes) -> set[bytes]:
    w = b" " + word[:24] + b" "
    return {w} | {w[:k] for k in (5, 6, 7, 8) if len(w) > k}


def _cover(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """A greedy cover of the toxic texts by word beginnings and words that ordinary texts hardly have: what a toxic dictionary has to hold."""
    holds, against = defaultdict(set), Counter()
    for i, t in enumerate(toxic):
        for w in set(words(t)):
            for s in _segments(w):
                holds[s].add(i)
    least = max(3, 0.002 * len(toxic))
    holds = {s: v for s, v in holds.items() if len(v) >= least}
    for t in ordinary:
        against.update({s for w in set(words(t)) for s in _segments(w) if s in holds})
    weight = 3 * len(toxic) / max(1, len(ordinary))
    live = {s: v for s, v in holds.items() if len(v) > 2 * weight * against[s]}
    left, chosen = set(range(len(toxic))), []
    while live:
        gain = {s: len(v & left) - weight * against[s] for s, v in live.items()}
        live = {s: v for s, v in live.items() if gain[s] >= least}
        if not live:
            break
        best = max(live, key=lambda s: (gain[s], len(s), s))
        chosen.append(best)
        left -= live.pop(best)
    return chosen


def fit(toxic: list[str], ordinary: list[str], seed: int = 0) -> Model:
    """Train both dictionaries and calibrate them on labelled texts."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    rng = random.Random(seed)
    segments = _cover(toxic, ordinary)
    if not segments or not ordinary:
        return Model()
    starts = tuple(segments)
    bad = [window(w) for t in toxic for w in words(t) if (b" " + w + b" ").startswith(starts)]
    good = [window(w) for t in ordinary for w in words(t)]
    rng.shuffle(bad)
    rng.shuffle(good)
    try:
        made = [
            zstd.train_dictionary(DICTIONARY_BYTES, x[:DICTIONARY_WINDOWS] * max(1, 2000 // len(x)), level=LEVEL).as_bytes() for x in (good, bad)
        ]
    except (zstd.ZstdError, ZeroDivisionError):  # too few windows for zstandard's trainer
        return Model()
    a, b = map(_compressor, made)
    known: dict[bytes, tuple[int, int, int]] = {}

    def cells(text: str) -> set[tuple[int, int, int]]:
        for w in (own := set(words(text))):
            if w not in known:
                x = window(w)
                known[w] = (len(x), len(a.compress(x)), len(b.compress(x)))
        return {known[w] for w in own}

    seen = [[cells(t) for t in texts] for texts in (ordinary, toxic)]
    n0, n1 = Counter(c for s in seen[0] for c in s), Counter(c for s in seen[1] for c in s)
    table = {c: math.log((n1[c] + 0.5) / (len(toxic) + 1)) - math.log((n0[c] + 0.5) / (len(ordinary) + 1)) for c in n0 | n1}
    # A window that the toxic dictionary doesn't shorten is no sign of toxicity, whatever its length says.
    table = {c: v if c[2] < c[1] else min(v, 0.0) for c, v in table.items()}
    best = [sorted(max((table[c] for c in s), default=-4.0) for s in kind) for kind in seen]
    # The threshold with the highest F1 at the classes' true shares, in the middle of the widest range that reaches it.
    marks = sorted({*best[0], *best[1]})
    top, at = -1.0, 0.0
    for low, high in zip(marks, [*marks[1:], marks[-1] + 2], strict=True):
        t = (low + high) / 2
        hit, wrong = sum(x > t for x in best[1]), sum(x > t for x in best[0])
        f1 = 2 * hit / (hit + wrong + len(toxic)) - 1e-9 * wrong
        if f1 > top:
            top, at = f1, t
    return Model(made[1], made[0], table, at)


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents whose crc32(doc_id) mod 5 is not 0, at most FIT_TOXIC and FIT_ORDINARY of them by a hash of the id."""
    ids = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, FIT_TOXIC), (0, FIT_ORDINARY))]
    picked = picked[0].union(picked[1])  # at most FIT_TOXIC + FIT_ORDINARY rows of two numbers: safe to broadcast
    rows = (
        docs.select("doc_id", "text").where(f"length(text) <= {FIT_CHARS}").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").toArrow()
    )
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, toxic = rows["text"].to_pylist(), rows["toxic"].to_pylist()
    return fit([t for t, k in zip(texts, toxic, strict=True) if k == 1], [t for t, k in zip(texts, toxic, strict=True) if k == 0])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "toxicity") -> DataFrame:
    """docs with a column of that name more: the score of every whole text, 0 to 1. Null and empty texts score as a text without toxic windows.

    Repeated rows are judged each on its own, an empty table gives an empty one,
    and whole texts of any length are read. A column of docs called like the score is replaced.
    """
    from pyspark.sql import types as T

    schema = T.StructType([f for f in docs.schema.fields if f.name != score] + [T.StructField(score, T.DoubleType())])
    kept = docs.select(*[f.name for f in schema.fields[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for b in batches:
            got = pa.array([f(t.as_py()) for t in b.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, score])

    return kept.mapInArrow(run, schema)


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, score="score")
    return scored.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
