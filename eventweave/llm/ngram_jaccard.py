"""Exact Jaccard join on sets of word 5-grams with prefix filters under several global token orders.

A document's set holds the 64-bit hashes of its distinct shingles. Documents of one and the same set form a class
(recognised by size and a 128-bit digest); only the class's smallest doc_id is joined. For a threshold of 0.8, two sets
of n and m tokens link if they share o = ceil(4 (n + m) / 9) of them. Their prefixes, the first n - ceil(0.8 n) + 1 tokens
of each, then share a token in ANY global order of the tokens:

* Every order puts the tokens last that are frequent in a sample of the documents, so that passages which many documents
  hold bring two of them together only where they fill four fifths of a text. Inside these groups each order has a
  permutation of its own. The sample decides the order alone; any order gives the same links.
* Order 1 makes the candidates: documents meet at equal prefix tokens. Of two sets, the first common token is among the
  first ninth of the smaller set's (or equal one's), so that one of both has to hold it there.
* Orders 2 and 3 are intersected with it before any set is moved. As at most n - o tokens of a set are not in the other
  one, linked sets share not one but at least min(p - (n - o), q - (m - o)) of their prefixes of p and q tokens under each.

Candidates are made in two rounds, so that a group of near copies never turns into all its pairs. Round one compares
each document with the smallest document of each of its prefix tokens. Round two looks only at tokens whose documents
are not all in one component, and pairs those outside the token's largest component with the others; that loses no link between
components, and links inside a component change no result. No candidate is capped.

What is left after the three orders passes one more lossless bound: each set has BITS bits, each the parity of its tokens
of one hash class; sets that differ in d tokens differ in at most d bits, and linked sets in at most (n + m) / 9 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, connected_components, drop_saved, mix, save, table, text_chunks, word_hashes

WORDS = 5
#: One document in so many is looked at for frequent tokens, which occur in at least LEAST of those; the most frequent ones that are told apart from the others.
SAMPLE, LEAST, FREQUENT = 16, 2, 2_000_000
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: What permutes the tokens in order 2, 3, ...; order 1 has them by their hash.
_ORDERS = {"o2": np.uint64(0xE7037ED1A0B428DB), "o3": np.uint64(0x8EBC6AF09C88C6E3)}
#: Bits of a set's parity signature.
BITS = 1024


def prefix_length(n):
    """Tokens that any partner of a set of n tokens must hit: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes (uint64)."""
    for _, n, data, offsets in text_chunks(texts):
        h, first = word_hashes(data, offsets)
        total = len(h)
        whole = np.zeros(max(total - WORDS + 1, 0), np.uint64)
        for k in range(WORDS):
            whole += h[k : k + len(whole)] * _PLACES[k]
        mix(whole)
        for i in range(n):
            a, b = first[i], first[i + 1]
            if b - a >= WORDS:
                yield np.unique(whole[a : b - WORDS + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


class Orders:
    """The global orders of the tokens: those known as frequent come last, by their frequency; the others by a permutation."""

    def __init__(self, frequent: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(frequent)
        self.frequent, self.count = frequent[order], count[order]

    def counts(self, s: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
        return np.where(self.frequent[at] == s, self.count[at], 0)

    def prefix(self, s: np.ndarray, count: np.ndarray, salt: np.uint64 | None = None) -> np.ndarray:
        """The prefix of a sorted set whose tokens have these counts, in order."""
        k = prefix_length(len(s)) if len(s) else 0
        key = s if salt is None else mix(s ^ salt)
        rare = np.flatnonzero(count == 0)
        if len(rare) >= k and salt is None:
            return s[rare[:k]]
        if len(rare) > k:
            rare = rare[np.argpartition(key[rare], k - 1)[:k]]
        rare = rare[np.argsort(key[rare])]
        if len(rare) < k:
            often = np.flatnonzero(count)
            rare = np.concatenate([rare, often[np.lexsort((key[often], count[often]))][: k - len(rare)]])
        return s[rare]


def frequent_tokens(docs: DataFrame) -> Orders:
    """The orders of a table's tokens, from the documents whose doc_id's hash is divisible by SAMPLE; at most FREQUENT tokens come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["token"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "token long")
    got = some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    return Orders(got["token"].to_numpy().view(np.uint64), got["n"].to_numpy())


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _digests(docs: DataFrame, orders: Orders) -> DataFrame:
    """doc_id, n, d1, d2 and the prefix under order 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0x9FB21C651E98DF25)
        for batch in batches:
            n, d1, d2, tokens = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                d1.append(mix(s * salt).sum().astype(np.int64))
                d2.append(mix(s ^ salt).sum().astype(np.int64))
                tokens.append(orders.prefix(s, orders.counts(s)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, d1, d2)], _lists(tokens, pa.int64())], names=["doc_id", "n", "d1", "d2", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, tokens array<long>")


def _sets(docs: DataFrame, ids: DataFrame, orders: Orders) -> DataFrame:
    """doc, n, its prefixes under orders 2 and 3, its parities and its whole set, of the documents named in ids(doc), from their whole texts."""
    names = ["doc", "n", *_ORDERS, "parity", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, size, found = batch.column("doc_id"), 0, 0, []

            def rows(doc: pa.Array, found: list) -> pa.RecordBatch:
                count = [orders.counts(s) for s in found]
                cols = [doc, pa.array([len(s) for s in found], pa.int64())]
                for salt in _ORDERS.values():  # 32 bits of a token are enough here: equal tokens stay equal
                    cols.append(_lists([np.unique(orders.prefix(s, c, salt).astype(np.uint32)).view(np.int32) for s, c in zip(found, count, strict=True)], pa.int32()))
                bits = [np.bincount((s >> np.uint64(7)).astype(np.int64) % BITS, minlength=BITS) & 1 for s in found]
                cols.append(_lists([np.packbits(b.astype(np.uint8)).view(np.int64) for b in bits], pa.int64()))
                return pa.RecordBatch.from_arrays([*cols, _lists([s.view(np.int64) for s in found], pa.int64())], names=names)

            for s in shingle_sets(batch.column("text")):
                found.append(s)
                size += len(s)
                if size > 500_000 or len(found) >= 512:
                    yield rows(doc.slice(at, len(found)), found)
                    at, size, found = at + len(found), 0, []
            if found:
                yield rows(doc.slice(at, len(found)), found)

    arrays = ", ".join(f"{x} array<int>" for x in _ORDERS)
    named = docs.select("doc_id", "text").join(checked(ids), F.col("doc") == F.col("doc_id"), "left_semi")
    return named.mapInArrow(run, f"doc long, n long, {arrays}, parity array<long>, tokens array<long>")


def _ids(pairs: DataFrame) -> DataFrame:
    return save(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct(), "jaccard-ids")


def _links(pairs: DataFrame, docs: DataFrame, orders: Orders) -> DataFrame:
    """The pairs (a, b) that link. They pass orders 2 and 3 and the parities; only what is left is compared on whole sets. Written."""
    ids = _ids(pairs)
    sets = save(_sets(docs, ids, orders), "jaccard-sets")

    def with_sets(df: DataFrame, columns: list[str], sets: DataFrame = sets) -> DataFrame:
        for side in "ab":
            df = df.join(sets.select(F.col("doc").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in columns]), side)
        return df

    shares = [
        f"size(array_intersect({k}_a, {k}_b)) >= greatest(1, least(size({k}_a) - (n_a - o), size({k}_b) - (n_b - o)))" for k in _ORDERS
    ]
    near = "9 * aggregate(zip_with(parity_a, parity_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= n_a + n_b"
    left = with_sets(pairs, ["n", *_ORDERS, "parity"]).withColumn("o", F.expr("(4 * (n_a + n_b) + 8) div 9"))
    for ok in ["5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)", *shares, near]:
        left = left.where(ok)
    left = save(left.select("a", "b").distinct(), "jaccard-left")
    few = _ids(left)  # only their sets move
    whole = with_sets(left, ["n", "tokens"], sets.join(checked(few), "doc", "left_semi")).withColumn("k", F.expr("size(array_intersect(tokens_a, tokens_b))"))
    links = save(whole.where("100 * k >= 80 * (n_a + n_b - k)").select("a", "b").distinct(), "jaccard-links")
    for done in (ids, sets, left, few):
        drop_saved(done)
    return links


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Null and empty texts and texts of spaces have no shingle and stand alone. Rows of equal text share a component. Rows
    that share a doc_id are versions of one document: what links to either is in its component. A row without doc_id
    keeps its size and has no component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    orders = frequent_tokens(docs)
    digests = save(_digests(docs, orders), "jaccard-digests")
    known = digests.where("n > 0 and doc_id is not null")
    # Written, so that joins with it are joins of two exchanges, which adaptive execution can split where copies are many.
    classes = save(known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    # Copies are few beside all documents, so it is they that are looked up: the tokens then need no shuffle to leave them out.
    copies = save(known.select("doc_id").distinct().join(classes.select("rep").distinct(), F.col("rep") == F.col("doc_id"), "left_anti"), "jaccard-copies")
    reps = known.join(checked(copies), "doc_id", "left_anti")
    # Rows that repeat an id are few as well: only among them are sets made distinct.
    versions = save(known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "jaccard-versions")
    again = checked(versions)
    reps = reps.join(again, "doc_id", "left_anti").unionByName(reps.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "d1", "d2"]))
    rows = reps.select(F.col("doc_id").alias("doc"), F.col("n").cast("int"), F.posexplode("tokens").alias("at", "token"))
    # A token of one document, or that no document has in its first ninth, makes no pair.
    small = F.expr("9L * (n - at) >= 8L * n")
    shared = rows.groupBy("token").agg(F.count("*").alias("c"), F.max(small).alias("early")).where("c > 1 and early").select("token")
    postings = save(rows.join(save(shared, "jaccard-tokens"), "token"), "jaccard-postings")
    first = postings.groupBy("token").agg(F.min(F.struct("doc", "n", "at")).alias("f"))
    first = first.select("token", F.col("f.doc").alias("a"), F.col("f.n").alias("m"), F.col("f.at").alias("at2"))

    close = "5L * least(n, m) >= 4L * greatest(n, m) and 9L * least(n - at, m - at2) >= 4L * (n + m)"
    pairs = save(postings.join(first, "token").where(f"doc <> a and {close}").select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")).distinct(), "jaccard-pairs")
    links = _links(pairs, docs, orders)

    comps = save(connected_components(links), "jaccard-comps")
    tagged = postings.join(comps, F.col("doc") == F.col("node"), "left").select("token", "doc", "n", "at", F.coalesce("component", "doc").alias("comp"))
    per = tagged.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("big"), F.count("*").alias("comps"))
    mixed = per.where("comps > 1").select("token", F.col("big.comp").alias("major"))
    open_ = save(tagged.join(mixed, "token").select("token", "doc", "n", "at", "comp", (F.col("comp") == F.col("major")).alias("major"), small.alias("small")), "jaccard-open")

    def meet(one: str, two: str) -> DataFrame:
        x = open_.where(one).select("token", F.col("doc").alias("a"), "n", "at", "comp")
        y = open_.where(two).select("token", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("at").alias("at2"), F.col("comp").alias("comp2"))
        return x.join(y, "token").where(f"a <> b and comp <> comp2 and {close}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # Of two sets of different components, one is outside the token's largest one, and the smaller set (or equal one) has the token early.
    more = meet("small and not major", "true").union(meet("not major", "small and major")).distinct()
    more = save(more.join(pairs, ["a", "b"], "left_anti"), "jaccard-more")
    late = _links(more, docs, orders)

    # A version of a document under the same id is in several classes; that also joins them.
    same = known.join(classes, ["n", "d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = same.join(versions.withColumnRenamed("doc_id", "a"), "a", "left_semi")
    final = connected_components(comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(late).union(same))
    for done in (postings, pairs, open_, more):
        drop_saved(done)
    rep = digests.join(classes, ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    out = rep.join(final, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
