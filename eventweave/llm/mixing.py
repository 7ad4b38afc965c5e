"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a fractional number of copies: its source's target over its source's size. The whole part is taken as
it is; the rest is the document's probability of one copy more. Pivotal rounding meets two documents of one source at a
time and moves mass (probability times size) at random from one to the other until one probability is 0 or 1, such
that every document keeps its probability in expectation and the source's mass is kept exactly. Blocks of a source are
rounded in parallel and leave one residual document each; the residuals are combined by a reduction tree, FAN_IN at a
time, so no task ever holds a whole source. The last residual of a source takes a copy that is cut at its mass, hence
the words taken from a source miss its target by less than a word for each unit of rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, table

#: The weights of the sources in their order, over and over; the share of all sizes that the mix takes; the most times a source is repeated.
WEIGHTS, TOTAL, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents of a block, and residuals that one step of the tree combines.
BLOCK, FAN_IN = 4096, 64

WORD = "[^\\x20\\x09-\\x0D]+"
_STATE = "src long, doc_id long, nth long, size long, p double, more long, block long"


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, src, source_size, target of a table (source, source_size) with one row per source.

    Sources are taken by code point, null last. The shares are filled like vessels: with the sources sorted by the level
    at which they are full (cap * size / weight), the first k are full and the others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("src", F.row_number().over(order).cast("long")).withColumn("weight", w)
    s = s.withColumn("full", cap * F.col("source_size")).withColumn("level", F.col("full") / F.col("weight"))
    upto = Window.orderBy("level", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    rest = F.lit(total) * F.col("all_size") - F.coalesce(F.sum("full").over(upto), F.lit(0.0))
    open_ = F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    s = s.withColumn("water", rest / open_)  # the level if exactly the sources before this one are full
    s = s.withColumn("water", F.max(F.when(F.col("water") <= F.col("level"), F.col("water"))).over(every))
    target = F.least("full", F.coalesce("water", "level") * F.col("weight"))
    return s.select("source", "src", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def pivot_block(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Round all rows of one block but the last one left: columns doc_id, nth, size, p; p becomes 0 or 1 except in at most one row."""
    import numpy as np

    rows = rows.sort_values(["size", "doc_id", "nth"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    rng = np.random.default_rng([seed, int(rows["src"].iloc[0]), *(int(x) & 0x7FFFFFFF for x in (rows["doc_id"].iloc[0], rows["nth"].iloc[0], len(rows)))])
    draw, p, w = rng.random(len(rows)), rows["p"].to_numpy().copy(), rows["size"].to_numpy().astype(float)
    held = -1
    for i in range(len(p)):
        if not 1e-12 < p[i] < 1 - 1e-12:
            p[i] = round(p[i])
        elif held < 0:
            held = i
        else:
            a, b = held, i
            up, down = min(w[a] * (1 - p[a]), w[b] * p[b]), min(w[a] * p[a], w[b] * (1 - p[b]))
            move = up if draw[i] < down / (up + down) else -down
            p[a] += move / w[a]
            p[b] -= move / w[b]
            for j in (a, b):
                if not 1e-12 < p[j] < 1 - 1e-12:
                    p[j] = round(p[j])
            open_ = [j for j in (a, b) if 0 < p[j] < 1]
            held = open_[0] if open_ else -1
    rows["p"] = p
    return rows


def mix_sources(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of docs(doc_id, text, source).

    size counts the words of the text (null: 0); an empty text takes part with size 0 and is never taken. taken is the
    words that the mix takes of the row: copies whole ones, and of one row for each source a part of a further copy. Equal
    rows are rounded on their own; the same input gives the same result whatever its partitions are.
    """
    sized = save(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h")), "mix-sizes"
    )
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = save(source_targets(per.select("source", "source_size"), weights, total, cap).join(per.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mix-targets")
    both = sized.join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    both = both.withColumn("whole", F.floor(copies + 1e-12).cast("long")).withColumn("p", F.greatest(copies - F.col("whole"), F.lit(0.0)))
    # Equal rows get a number; a doc_id that is not repeated has nth 1, and one that is repeated often is a key of its own text.
    again = sized.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("d2"))
    nth = F.when(F.col("d2").isNull() & F.col("doc_id").isNotNull(), F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("doc_id", "src").orderBy("size", "h")))
    both = both.join(again, F.col("doc_id") == F.col("d2"), "left")
    rows = both.where("d2 is null and doc_id is not null").withColumn("nth", F.lit(1).cast("long")).unionByName(
        both.where("d2 is not null or doc_id is null").withColumn("nth", nth.cast("long"))
    ).drop("d2", "h")
    rows = save(rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63) + 1))), "mix-rows")
    block = F.pmod(F.xxhash64("key", "nth"), F.ceil(F.col("n") / BLOCK))
    state = rows.where("size > 0 and p > 0").select("src", F.col("key").alias("doc_id"), "nth", "size", "p", F.lit(0).cast("long").alias("more"), block.cast("long").alias("block"))
    widest = per.agg(F.max("n")).first()[0] or 0
    blocks = -(-widest // BLOCK)

    def run(last: bool):
        def step(rows: pd.DataFrame) -> pd.DataFrame:
            out = pivot_block(rows, seed)
            open_ = (out["p"] > 0) & (out["p"] < 1)
            out["more"] = (out["p"] * out["size"]).round().astype("int64")
            if not last:
                out.loc[open_, "more"] = -1
            out["block"] = out["block"] // FAN_IN
            return out[["src", "doc_id", "nth", "size", "p", "more", "block"]]

        return step

    done = None
    while True:
        last = blocks <= 1
        state = save(state.groupBy("src", "block").applyInPandas(run(last), _STATE), "mix-step")
        ended = state.where("more >= 0").select("src", "doc_id", "nth", "more")
        done = ended if done is None else done.union(ended)
        if last:
            break
        state, blocks = state.where("more < 0").withColumn("more", F.lit(0).cast("long")), -(-blocks // FAN_IN)
    done = done.select(F.col("src").alias("s2"), F.col("doc_id").alias("d2"), F.col("nth").alias("n2"), "more")
    same = (F.col("src") == F.col("s2")) & (F.col("key") == F.col("d2")) & (F.col("nth") == F.col("n2"))
    out = rows.join(done, same, "left").withColumn("taken", F.col("whole") * F.col("size") + F.coalesce("more", F.lit(0)))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") + (F.coalesce("more", F.lit(0)) == F.col("size")).cast("long") * (F.col("size") > 0).cast("long")).alias("copies"), "taken"
    )


def mixing_query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")
