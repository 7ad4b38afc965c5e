"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words (letters, digits and underscores, lower-cased). A window of a document matches a benchmark
item of n words if it is as long as the item and their word edit distance is at most floor(EDITS * n). A window starts
at every word; a document shorter than the item is one window of its own, if its length alone doesn't exceed the bound.

The CGK embedding walks over a window with one pointer: at step t it writes the word under the pointer and moves on if
a random bit of (t, word) says so. Two windows of edit distance k, walked with the same bits, differ in few of their
3n written symbols. Each repetition has its own bits and keeps SAMPLES random places of the walk as its key; windows
meet an item where a key is equal. The number of repetitions is fitted: edited copies of the items themselves are
drawn, the share that one repetition finds is measured, and repetitions are added until the misses are below
1 - RECALL. Windows that meet an item are verified by edit distance, so no wrong match remains. Lengths for which
MOST_REPETITIONS don't reach it (long items: many edits) are exact instead: all windows that pass the count below are verified.

Before they are walked, windows pass a lossless count: k edits destroy at most 2k of an item's n - 1 word pairs, so a
window with fewer than n - 1 - 2k pairs of the benchmark can match nothing of that length.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Word edits that a match may have, as a share of the item's words.
EDITS = 0.2
#: Share of matching windows that the LSH is fitted to find.
RECALL = 0.995
SAMPLES, TRIALS, MOST_REPETITIONS = 2, 200, 128
#: Words of a document that are looked at at once, besides the overlap of one item.
BLOCK = 200_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def allowed(n: int) -> int:
    return int(EDITS * n + 1e-9)


def edit_distance(a, b, most: int) -> int:
    """Word edit distance of two sequences, or most + 1 where it is larger. One bit of an integer stands for each word of a (bit-parallel columns)."""
    n = len(a)
    if abs(n - len(b)) > most or not n:
        return min(max(n, len(b)), most + 1)
    has: dict = {}
    for i, x in enumerate(a):
        has[x] = has.get(x, 0) | 1 << i
    every, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = every, 0, n  # places where a column's value is one more, or one less, than above
    for x in b:
        eq = has.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (every & ~(diagonal | up)), up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & every, (left << 1) & every
        down, up = right & (eq | down), left | (every & ~(eq | down | right))
    return min(score, most + 1)


def _bits(seed: int, t: int, symbols: np.ndarray) -> np.ndarray:
    h = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xC2B2AE3D27D4EB4F + t * 0x165667B19E3779F9) & (2**64 - 1))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(63)).astype(np.int64)


def cgk(windows: np.ndarray, seed: int, places: np.ndarray) -> np.ndarray:
    """The symbols that the walk writes at the given (sorted) places: windows is rows of word ids, the result one row each."""
    k, n = windows.shape
    padded = np.concatenate([windows, np.full((k, 1), -2, windows.dtype)], axis=1)
    at, rows, out, wanted = np.zeros(k, np.int64), np.arange(k), np.empty((k, len(places)), windows.dtype), {}
    for i, p in enumerate(places):
        wanted.setdefault(int(p), []).append(i)
    for t in range(int(places[-1]) + 1):
        now = padded[rows, at]
        for i in wanted.get(t, ()):
            out[:, i] = now
        at = np.minimum(at + _bits(seed, t, now), n)
    return out


def _places(seed: int, n: int) -> np.ndarray:
    # The walk has passed all n words after about 2n of its 3n steps; places beyond tell nothing apart.
    return np.sort(np.random.default_rng([seed, n]).choice(max(2 * n, 1), size=min(SAMPLES, max(2 * n, 1)), replace=False))


def _key(sample: np.ndarray) -> np.ndarray:
    h = np.zeros(len(sample), np.uint64)
    for c in sample.T:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(31)
    return h


@dataclass
class Index:
    """The benchmark: items as word ids by length, and the LSH tables."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    items: dict[int, list[tuple[int, tuple[int, ...]]]] = field(default_factory=dict)  # length -> (item_id, word ids)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pairs_of: dict[int, np.ndarray] = field(default_factory=dict)  # the pairs of the items of each length
    repetitions: dict[int, int] = field(default_factory=dict)
    exact: set[int] = field(default_factory=set)  # lengths whose windows are all verified
    tables: dict[int, list[dict[int, list[int]]]] = field(default_factory=dict)  # length -> repetition -> key -> places in items


def build_index(benchmark: list[tuple[int, str]], seed: int = 0) -> Index:
    """benchmark: (item_id, text). Items without a word match nothing; equal texts are kept as items of their own."""
    ix = Index()
    rng = random.Random(seed)
    by = defaultdict(list)
    for item, text in sorted(benchmark, key=lambda x: (x[0], x[1] or "")):
        if item is not None and (w := words(text)):
            by[len(w)].append((item, tuple(ix.vocabulary.setdefault(x, len(ix.vocabulary)) for x in w)))
    ix.items = dict(by)
    v = len(ix.vocabulary) + 1
    ix.pairs_of = {n: np.unique([a * v + b for _, w in group for a, b in zip(w, w[1:], strict=False)] or [-1]).astype(np.int64) for n, group in by.items()}
    ix.pairs = np.unique(np.concatenate([*ix.pairs_of.values(), [-1]]))
    for n, group in by.items():
        k, trials = allowed(n), []
        for _ in range(TRIALS if k else 1):  # windows at the full distance: the hardest that have to be found
            w = list(rng.choice(group)[1])
            base = list(w)
            for _ in range(k):
                kind, p = rng.randrange(3), rng.randrange(len(w))
                if kind == 0:
                    w[p] = -1
                elif kind == 1 and len(w) > 1:
                    del w[p]
                else:
                    w.insert(p, -1)
            trials.append((base, (w + [-1] * n)[:n]))
        a, b = np.array([x for x, _ in trials], np.int64), np.array([y for _, y in trials], np.int64)
        ok = np.array([edit_distance(x, y, k) <= k for x, y in trials])
        a, b = (a[ok], b[ok]) if ok.any() else (a, a)
        missed, r = np.ones(len(a), bool), 0
        while r < MOST_REPETITIONS and (r < 2 or missed.mean() > (1 - RECALL) / 2):
            places = _places(r, n)
            missed &= _key(cgk(a, r, places)) != _key(cgk(b, r, places))
            r += 1
        if missed.mean() > (1 - RECALL) / 2:
            ix.exact.add(n)
            continue
        ix.repetitions[n] = r
        rows = np.array([w for _, w in group], np.int64)
        ix.tables[n] = []
        for s in range(r):
            t = defaultdict(list)
            for i, h in enumerate(_key(cgk(rows, s, _places(s, n))).tolist()):
                t[h].append(i)
            ix.tables[n].append(dict(t))
    return ix


def find(ix: Index, texts: list[str | None]) -> list[dict[int, int]]:
    """For each text, item_id -> smallest edit distance of the items that one of its windows matches."""
    get = ix.vocabulary.get
    best: list[dict[int, int]] = [{} for _ in texts]
    longest = max(ix.items, default=0)
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = defaultdict(list)  # length -> (windows, pairs in each, text)
    least = min((_least(n) for n in ix.items), default=0)
    for d, text in enumerate(texts):
        ids = np.array([get(x, -1) for x in words(text)], np.int64)
        for start in range(0, max(len(ids) - longest + 1, 1), BLOCK):
            part = ids[start : start + BLOCK + longest - 1]
            code = _codes(ix, part)
            if not longest or not len(ids):
                continue
            hits = np.concatenate([[0], np.cumsum(_among(code, ix.pairs))])
            if hits[-1] >= least:
                for n in ix.items:
                    if len(part) < n or (hits[n - 1 :] - hits[: len(hits) - n + 1]).max() >= _least(n):
                        _windows(ix, n, part, code, len(ids), d, waiting)
    for n, found in waiting.items():
        _match(ix, n, found, best)
    return best


def _least(n: int) -> int:
    return n - 1 - 2 * allowed(n)


def _codes(ix: Index, ids: np.ndarray) -> np.ndarray:
    return np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * (len(ix.vocabulary) + 1) + ids[1:], -2)


def _among(code: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code


def _windows(ix: Index, n: int, ids: np.ndarray, code: np.ndarray, total: int, d: int, waiting) -> None:
    """The windows of n words that hold enough pairs of the items of that length."""
    hits = np.concatenate([[0], np.cumsum(_among(code, ix.pairs_of[n]))])
    if hits[-1] < _least(n):
        return
    if len(ids) < n:
        if total < n and total >= n - allowed(n):
            waiting[n].append((np.concatenate([ids, np.full(n - len(ids), -2, np.int64)])[None, :], hits[-1:], d))
        return
    count = hits[n - 1 :] - hits[: len(hits) - n + 1]
    starts = np.flatnonzero(count >= _least(n))
    if _least(n) <= 0:  # so short that the count says nothing: at least one word has to be an item's
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        starts = starts[known[starts + n] > known[starts]]
    if len(starts):
        waiting[n].append((np.lib.stride_tricks.sliding_window_view(ids, n)[starts], count[starts], d))


def _match(ix: Index, n: int, found, best) -> None:
    k, group = allowed(n), ix.items[n]
    windows = np.concatenate([w for w, _, _ in found])
    count = np.concatenate([c for _, c, _ in found])
    text = np.repeat([d for _, _, d in found], [len(w) for w, _, _ in found])
    meet = {(i, j) for i in range(len(windows)) for j in range(len(group))} if n in ix.exact else set()
    for r in range(ix.repetitions.get(n, 0)):
        t = ix.tables[n][r]
        for i, h in enumerate(_key(cgk(windows, r, _places(r, n))).tolist()):
            if h in t:
                meet.update((i, j) for j in t[h])
    for i, j in sorted(meet, key=lambda x: (-count[x[0]], x)):
        item, w = group[j]
        own = best[text[i]]
        most = min(k, own.get(item, k + 1) - 1)
        if most >= 0 and n - 1 - count[i] <= 2 * most:  # the count bounds the distance as well
            x = [v for v in windows[i].tolist() if v != -2]
            there = set(x)
            if sum(v not in there for v in w) > most:  # each of these words costs an edit
                continue
            d = edit_distance(w, x, most)
            if d <= most:
                own[item] = d


def find_contamination(docs: DataFrame, ix: Index) -> DataFrame:
    """docs with contaminated boolean, item_ids array<long> (sorted), edits array<int> (of each item) more.

    Null and empty texts match nothing. Items of equal texts are all named. Repeated rows are judged each on its own, an empty table gives an empty one,
    and whole texts of any length are read.
    Columns of docs with these names are replaced.
    """
    from pyspark.sql import types as T

    extra = [T.StructField("contaminated", T.BooleanType()), T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("edits", T.ArrayType(T.IntegerType()))]
    own = [f for f in docs.schema.fields if f.name not in {x.name for x in extra}]
    schema = T.StructType(own + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(x.items()) for x in find(ix, b.column("text").to_pylist())]
            more = [
                pa.array([bool(x) for x in found], pa.bool_()),
                pa.array([[int(i) for i, _ in x] for x in found], pa.list_(pa.int64())),
                pa.array([[int(d) for _, d in x] for x in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "contaminated", "item_ids", "edits"])

    return docs.select(*[f.name for f in own]).mapInArrow(run, schema)


def index_of(benchmark: DataFrame, most_items: int = 100_000, most_chars: int = 100_000_000) -> Index:
    """The index of a benchmark table. The benchmark is a stated query set: it travels to every executor, and one of more items or characters is refused."""
    rows = benchmark.select("item_id", "text").where("item_id is not null")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    if size.n > most_items or size.chars > most_chars:
        raise ValueError(f"the benchmark has more than {most_items} items or {most_chars} characters; split it and run once for each part")
    return build_index([(r.item_id, r.text) for r in rows.collect()])


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, min_edits for every document."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), index_of(table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "contaminated", F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.array_min("edits").alias("min_edits"))

