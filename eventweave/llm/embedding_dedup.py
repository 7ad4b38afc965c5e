"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees.

Vectors are scaled to length one, where a cosine of at least c is a distance of at most sqrt(2 - 2c). Equal vectors are
one class and enter once, with their number. The classes are dealt to blocks: a bounded sample of pivots attracts the
vectors nearest to it, and a pivot with more than BLOCK of them has several blocks. Each block becomes a cover tree:
nested levels whose radii halve, every node knowing its covering radius. Pairs of blocks, and inside them pairs of
nodes, are pruned where the centres are farther apart than the threshold plus both covering radii; where even the
farthest vectors of two nodes are near enough, all their pairs link at once and are counted, not listed. What remains
is compared vector by vector in double precision. A task returns link counts and a few edges that span what it found,
never the pairs.

In high dimensions vectors without structure are all about equally far apart, no bound can tell them apart, and every
block meets every other: the work is then quadratic in the number of distinct vectors, as for any exact method.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, save, table

#: Vectors of a block; pivots at most; vectors of a leaf; slack of the pruning bounds for rounding.
BLOCK, PIVOTS, LEAF, SLACK = 4096, 256, 64, 1e-9


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _build(x: np.ndarray) -> dict:
    """The tree as arrays, its vectors in the tree's order."""
    first, last, radius, centres, children, order = [], [], [], [], [], []
    n = 0

    def add(rows: np.ndarray, centre: int, far: float, parent: int) -> int:
        k = len(first)
        first.append(n), last.append(n + len(rows)), radius.append(far), centres.append(x[centre]), children.append([])
        if parent >= 0:
            children[parent].append(k)
        return k

    stack = [(np.arange(len(x)), 0, 2.0, -1)]
    while stack:
        rows, centre, level, parent = stack.pop()
        d = np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))
        far = float(d.max())
        k = add(rows, centre, far, parent)
        if len(rows) <= LEAF or far == 0.0 or level == 0.0:
            order.append(rows)
            n += len(rows)
            continue
        while level / 2 >= far:  # levels at which the node is its own only child
            level /= 2
        level /= 2
        parts, lone, c = [], [], centre
        if len(rows) > 4 * LEAF:  # at once, those with no other vector near
            cut = 1 - level * level / 2 - SLACK
            own = x[rows]
            some = np.concatenate([(own[i : i + 512] @ own.T >= cut).sum(axis=1) > 1 for i in range(0, len(rows), 512)])
            lone.append(rows[~some])
            rows = rows[some]
            if len(rows):
                c = int(rows[0])
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[rows] @ x[c])))
                d[0] = 0.0
        while len(rows):
            near = d <= level
            if near.sum() <= 2:
                lone.append(rows[near])
            else:
                parts.append((rows[near], c, level, k))
            rows = rows[~near]
            if not len(rows):
                break
            c = int(rows[0])
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[rows] @ x[c])))
            d[0] = 0.0
        # Nodes of one or two vectors are kept together as leaves, not as a node each.
        alone = np.concatenate(lone) if lone else np.zeros(0, np.int64)
        parts += [(alone[i : i + 16 * LEAF], int(alone[i]), 0.0, k) for i in range(0, len(alone), 16 * LEAF)]
        stack.extend(reversed(parts))
    return {"first": first, "last": last, "radius": radius, "centres": np.array(centres), "children": children, "order": np.concatenate(order)}


def build_tree(ids: np.ndarray, copies: np.ndarray, rows) -> bytes:
    """A block's tree with its vectors as they were given (unscaled), for the way between tasks."""
    t = _build(unit(rows))
    raw = np.stack([np.asarray(r) for r in rows])[t["order"]]
    return pickle.dumps(t | {"ids": ids[t["order"]], "copies": copies[t["order"]], "raw": raw, "centres": t["centres"].astype(np.float64)})


def load_tree(blob: bytes) -> dict:
    t = pickle.loads(blob)
    return t | {"x": unit(t["raw"])}


class Found:
    """What the traversal of two trees has found: links of each row of both, and edges that span them."""

    def __init__(self, a: dict, b: dict) -> None:
        self.a, self.b, self.same = a, b, a is b
        self.links = (np.zeros(len(a["ids"]), np.int64), np.zeros(len(b["ids"]), np.int64))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def all_pairs(self, i: slice, j: slice) -> None:
        a, b = self.a, self.b
        self.links[0][i] += b["copies"][j].sum()
        self.links[1][j] += a["copies"][i].sum()
        if self.same and i == j:  # both sums hold a vector's own copies, and count each other one twice
            self.links[0][i] -= a["copies"][i]
            self.links[1][j] -= a["copies"][i].sum()
        self.edges.append((a["ids"][i], np.full(i.stop - i.start, b["ids"][j.start])))
        self.edges.append((np.full(j.stop - j.start, a["ids"][i.start]), b["ids"][j]))

    def compare(self, i: slice, j: slice, cosine: float) -> None:
        a, b = self.a, self.b
        hit = a["x"][i] @ b["x"][j].T >= cosine
        if self.same and i == j:
            hit = np.triu(hit, 1)
        if not hit.any():
            return
        self.links[0][i] += hit @ b["copies"][j]
        self.links[1][j] += hit.T @ a["copies"][i]
        # Labels spread over the links until they rest; an edge to each row's label spans what is linked.
        big = np.int64(2**63 - 1)
        p, q = a["ids"][i].copy(), b["ids"][j].copy()
        if hit.sum() <= 4 * (len(p) + len(q)):
            r, c = np.nonzero(hit)
            self.edges.append((p[r], q[c]))
            return
        own_p, own_q, rows, cols = p.copy(), q.copy(), hit.any(axis=1), hit.any(axis=0)
        while True:
            new_q = np.minimum(q, np.where(hit, p[:, None], big).min(axis=0))
            new_p = np.minimum(p, np.where(hit, new_q[None, :], big).min(axis=1))
            if (new_q == q).all() and (new_p == p).all():
                break
            p, q = new_p, new_q
        self.edges.append((own_p[rows], p[rows]))
        self.edges.append((own_q[cols], q[cols]))


def traverse(a: dict, b: dict, cosine: float) -> Found:
    """Dual traversal of two trees, or of one with itself."""
    found, near = Found(a, b), math.sqrt(max(0.0, 2 - 2 * cosine))
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        d = math.sqrt(max(0.0, float(((a["centres"][p] - b["centres"][q]) ** 2).sum())))
        ra, rb = a["radius"][p], b["radius"][q]
        if d > near + ra + rb + SLACK:
            continue
        i, j = slice(a["first"][p], a["last"][p]), slice(b["first"][q], b["last"][q])
        own = found.same and p == q
        if d + ra + rb < near - SLACK:
            found.all_pairs(i, j)
            continue
        ca, cb = a["children"][p], b["children"][q]
        if not ca and not cb:
            found.compare(i, j, cosine)
        elif own:
            stack.extend((x, y) for n, x in enumerate(ca) for y in ca[n:])
        elif ca and (not cb or ra >= rb):
            c = np.sqrt(np.maximum(0.0, ((a["centres"][ca] - b["centres"][q]) ** 2).sum(axis=1)))
            stack.extend((x, q) for x, e in zip(ca, c, strict=True) if e <= near + a["radius"][x] + rb + SLACK)
        else:
            c = np.sqrt(np.maximum(0.0, ((b["centres"][cb] - a["centres"][p]) ** 2).sum(axis=1)))
            stack.extend((p, y) for y, e in zip(cb, c, strict=True) if e <= near + b["radius"][y] + ra + SLACK)
    return found


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            yield rows.assign(cell=(unit(rows["vector"]) @ pivots.T).argmax(axis=1))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors; other columns take no part.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and vectors of different
    lengths never with each other. Rows of one vec_id are rows of their own that share their links' names.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[embedding]
    real = f"size({embedding}) > 0 and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({embedding}, x -> x <> 0)"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector")).withColumn("ok", F.coalesce(F.expr(real.replace(embedding, "vector")), F.lit(False)))
    classes = rows.where("ok and vec_id is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = save(classes.withColumn("dims", F.size("vector")), "embedding-classes")
    per = {r.dims: r.n for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    found = None
    for dims, n in sorted(per.items()):
        one = _links(classes.where(F.col("dims") == dims), n, cosine, kind)
        found = one if found is None else found.union(one)
    if found is None:
        none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return none.withColumn("kept", F.lit(True))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "8")  # a row holds two trees
    try:
        found = save(found, "embedding-links")
    finally:
        spark.conf.set(batch, before)
    counts = found.where("what = 'links'").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    comps = connected_components(found.where("what = 'edge'").select("a", "b"))
    known = classes.select("vector", "rep", "copies").join(counts, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("vector").alias("v2"), "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component"))
    good = rows.where("ok and vec_id is not null").join(known, F.col("vector") == F.col("v2")).select("vec_id", (F.col("copies") - 1 + F.col("n")).alias("n_links"), F.col("component").alias("component_id"))
    bad = rows.where("not ok or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(classes: DataFrame, n: int, cosine: float, kind: str) -> DataFrame:
    """what ('links': b links of class a; 'edge': a and b link, or span linked ones), a, b."""
    near = math.sqrt(max(0.0, 2 - 2 * cosine))
    k = max(1, min(PIVOTS, -(-n // BLOCK)))
    pivots = unit([r.vector for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(k).collect()])
    dealt = classes.select("rep", "copies", "vector").mapInPandas(_nearest(pivots), f"rep long, copies long, vector {kind}, cell long")
    dealt = save(dealt, "embedding-cells")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))  # at most PIVOTS rows
    sub = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        blob = build_tree(rows["rep"].to_numpy(), rows["copies"].to_numpy(), list(rows["vector"]))
        t = load_tree(blob)
        far = float(np.sqrt(((t["x"] - pivots[int(rows["cell"].iloc[0])]) ** 2).sum(axis=1)).max())
        return pd.DataFrame({"block": [int(rows["cell"].iloc[0]) * 2**32 + int(rows["part"].iloc[0])], "cell": [rows["cell"].iloc[0]], "radius": [far], "tree": [blob]})

    trees = save(sub.groupBy("cell", "part").applyInPandas(build, "block long, cell long, radius double, tree binary"), "embedding-trees")
    # Pairs of cells whose balls come near enough: at most PIVOTS^2, from a table of PIVOTS rows.
    reach = {r.cell: r.r for r in trees.groupBy("cell").agg(F.max("radius").alias("r")).collect()}
    spark = classes.sparkSession
    cells = sorted(reach)
    close = [
        (p, q) for p in cells for q in cells if p <= q and math.sqrt(max(0.0, ((pivots[p] - pivots[q]) ** 2).sum())) <= reach[p] + reach[q] + near + SLACK
    ]
    close = F.broadcast(spark.createDataFrame(close, "cell long, cell2 long"))
    # A block's number begins with its cell's, so block <= block2 keeps each pair once.
    meta = trees.select("block", "cell")
    pairs = meta.join(close, "cell").join(meta.select(F.col("block").alias("block2"), F.col("cell").alias("cell2")), "cell2").where("block <= block2").select("block", "block2")
    left = trees.select("block", "tree")
    pairs = pairs.join(left, "block").join(left.select(F.col("block").alias("block2"), F.col("tree").alias("tree2")), "block2")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield one_batch(rows)

    def one_batch(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for one, two, x, y in zip(rows["block"], rows["block2"], rows["tree"], rows["tree2"], strict=True):
            a = load_tree(x)
            b = a if one == two else load_tree(y)
            f = traverse(a, b, cosine)
            if f.same:
                out.append(("links", a["ids"], f.links[0] + f.links[1]))
            else:
                out += [("links", a["ids"], f.links[0]), ("links", b["ids"], f.links[1])]
            out += [("edge", p, q) for p, q in f.edges]
        what = np.repeat([w for w, _, _ in out], [len(p) for _, p, _ in out])
        done = pd.DataFrame({"what": what, "a": np.concatenate([p for _, p, _ in out]), "b": np.concatenate([q for _, _, q in out])})
        done = done[(done["what"] == "edge") & (done["a"] != done["b"]) | (done["what"] == "links") & (done["b"] > 0)]
        edges, links = done[done["what"] == "edge"].drop_duplicates(), done[done["what"] == "links"]
        return pd.concat([edges, links.groupby(["what", "a"], as_index=False)["b"].sum()])

    return pairs.select("block", "block2", "tree", "tree2").mapInPandas(meet, "what string, a long, b long")


def embedding_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
