"""Cross-entropy difference: a target and a background bigram model over one vocabulary score every document.

The background model is counted over all documents, the target model over all good ones. Both use the same vocabulary,
which is every word of all documents. With v the word before (or the beginning), w a word or the end and V the number of
words and two more (the end, and a place for what is unknown),

    p(w | v) = BIGRAM * c(v, w) / c(v) + (1 - BIGRAM) * (c(w) + 1) / (N + V)

and a document's score is the mean over its tokens of the target model's loss minus the background model's: the lower,
the more it is like the target.

Counts and documents meet at bigrams. Pairs of the HOT most frequent words, which hold most of the tokens, are a dense
table of bounded size that travels to every executor. Any other pair has a word beyond the HOT first, so it holds
less than 1 / HOT of all tokens; those are dealt out by bigram, counted there, and summed by document. The counts of the
KNOWN most frequent words travel as well. A pair with a tail word, one beyond them, is dealt out by that word, so that it
meets the word's counts in the same shuffle; pairs of two tail words, which are few, get the second one's counts in a
join before. No count is capped, and no rare word or bigram is left out.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, mix, save, table, text_chunks, word_hashes

KNOWN, HOT, BIGRAM = 262_144, 1024, 0.7
#: Most words of the vocabulary and two more, the others being one unknown word; None: every word is in it.
VOCABULARY: int | None = None
#: Keys of the shuffle: tail words are negative, codes of two known words below DOCUMENT, rows of a document from there on.
DOCUMENT, WORD = 1 << 40, 1 << 62
#: Rows that a task holds at once; a pair of known words with more of them waits on disk.
ROWS = 1 << 17
UNKNOWN, EDGE = 0, 1  # EDGE is the beginning of a document as a context and its end as a token


def _counts(docs: DataFrame) -> DataFrame:
    """word (hash), n, n_target over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = b.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for at, n, data, offsets in text_chunks(b.column("text")):
                h, first = word_hashes(data, offsets)
                own = np.repeat(good[at : at + n], np.diff(first))
                word, where = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(np.bincount(where, minlength=len(word))), pa.array(np.bincount(where[own], minlength=len(word)))],
                    names=["word", "n", "n_target"],
                )

    parts = docs.select("text", "target").mapInArrow(run, "word long, n long, n_target long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


class Vocabulary:
    """Hashes of the known words (sorted) with their ids by frequency from 2 on, and counts by id for both models."""

    def __init__(self, words: np.ndarray, n: np.ndarray, n_target: np.ndarray, total: int, total_target: int, docs: int, docs_target: int, types: int | None) -> None:
        order = np.argsort(words.view(np.uint64))
        self.words, self.ids = words.view(np.uint64)[order], (np.arange(len(words)) + 2)[order].astype(np.int64)
        self.unigram = np.array([[total - n.sum(), docs, *n], [total_target - n_target.sum(), docs_target, *n_target]], dtype=np.float64)
        self.total = self.unigram.sum(axis=1)
        self.size = len(words) + 2
        self.tail = types is not None  # whether the other words are words of their own
        self.types = (types if self.tail else len(words)) + 2
        if self.tail:
            self.unigram[:, UNKNOWN] = 0

    def pairs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, context, token) of every token: ids of known words; a tail word is its hash with the top bit set."""
        h, first = word_hashes(data, offsets)
        other = (h | np.uint64(1 << 63)).view(np.int64) if self.tail else np.full(len(h), UNKNOWN, np.int64)
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        ids = np.where(self.words[at] == h, self.ids[at], other) if len(self.words) else other
        count = np.diff(first)
        some = count > 0
        start = first[:-1][some]
        context = np.insert(ids, start, EDGE)  # each document is its words with EDGE before
        token = np.insert(ids, first[1:][some], EDGE)
        doc = np.repeat(np.flatnonzero(some), count[some] + 1)
        return doc, context, token

    def loss(self, n: np.ndarray, context: np.ndarray, token: np.ndarray, model: int) -> np.ndarray:
        """Loss of a bigram from its count, its context's and its token's."""
        own = (token + 1) / (self.total[model] + self.types)
        return -np.log(np.where(context > 0, BIGRAM * n / np.maximum(context, 1), 0) + (1 - BIGRAM) * own)


def _vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and key, n, n_target of all words as tail words."""
    counts = save(_counts(docs), "lm-words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0)), F.count("*")).first()
    some = docs.where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").agg(F.count("*"), F.coalesce(F.sum(F.col("target").cast("long")), F.lit(0))).first()
    # How often a word occurs, in steps of a 16th of an octave: the steps from the top on that hold less than KNOWN words travel. No order of all words is needed.
    step = F.floor(F.log2("n") * 16).cast("int")
    if VOCABULARY:
        known, rest = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - 2), counts.limit(0)
    else:
        held, first = 0, 2**31 - 1
        for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):  # at most 1024 rows
            held += r.words
            if held > KNOWN - 2:
                break
            first = r.step
        known, rest = counts.where(step >= first), counts.where(step < first)
    top = known.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    cols = [np.ascontiguousarray(top[c].to_numpy()) for c in ("word", "n", "n_target")]
    voc = Vocabulary(*cols, int(totals[0]), int(totals[1]), int(some[0]), int(some[1]), None if VOCABULARY else int(totals[2]))
    return voc, rest.select(F.expr("word | (-9223372036854775807L - 1L)").alias("key"), "n", "n_target")


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of parallel columns, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _pair_counts(docs: DataFrame, voc: Vocabulary) -> tuple[np.ndarray, DataFrame]:
    """Counts [model, context * HOT + token] of the pairs of hot words, of which at most HOT^2 rows come to the driver, and the distinct pairs v, w of tail words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, HOT * HOT), np.int64)
        row = lambda *c: pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["pair", "w", "n", "n_target"])
        for b in batches:
            good = b.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for at, _, data, offsets in text_chunks(b.column("text")):
                doc, v, w = voc.pairs(data, offsets)
                hot = (v >= 0) & (v < HOT) & (w >= 0) & (w < HOT)
                key = v[hot] * HOT + w[hot]
                n[0] += np.bincount(key, minlength=HOT * HOT)
                n[1] += np.bincount(key[good[at + doc[hot]]], minlength=HOT * HOT)
                tail = (v < 0) & (w < 0)
                if tail.any():
                    (x, y), many = _distinct(v[tail], w[tail])
                    yield row(x, y, many, many)
        some = np.flatnonzero(n[0])
        yield row(some, np.zeros(len(some), np.int64), n[0][some], n[1][some])

    rows = save(docs.select("text", "target").mapInArrow(run, "pair long, w long, n long, n_target long"), "lm-pairs")
    got = rows.where("pair >= 0").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).toArrow()
    out = np.zeros((2, HOT * HOT))
    out[:, got["pair"].to_numpy()] = [got["n"].to_numpy(), got["n_target"].to_numpy()]
    return out, rows.where("pair < 0").select(F.col("pair").alias("v"), "w").distinct()


def score_documents(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every document of docs(doc_id, text).

    target_ids(doc_id) names the target's documents, as many as there are: a table that is too large to broadcast is joined by
    one shuffle of the texts. n_tokens counts the words and the end of the text; a null or empty text, or one of spaces, has no token and losses of 0. Rows that share a doc_id are parts of
    one document: it has one row, with all their tokens.
    """
    ids = target_ids.select(F.col("doc_id").alias("t_id")).where("t_id is not null").distinct()
    side = checked(ids)
    docs = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "text", F.col("t_id").isNotNull().alias("target"))
    if side is ids:  # no broadcast: the texts are shuffled once, not in every pass
        docs = save(docs, "lm-documents")
    voc, words = _vocabulary(docs)
    hot, tails = _pair_counts(docs, voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.arange(HOT * HOT)
        v, w = np.minimum(grid // HOT, voc.size - 1), np.minimum(grid % HOT, voc.size - 1)
        table_ = [voc.loss(hot[m], voc.unigram[m][v], voc.unigram[m][w], m) for m in (0, 1)]
        for b in batches:
            good = b.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for at, n, data, offsets in text_chunks(b.column("text")):
                doc, v, w = voc.pairs(data, offsets)
                known = (v >= 0) & (w >= 0)
                is_hot = known & (v < HOT) & (w < HOT)
                key = v[is_hot] * HOT + w[is_hot]
                sums = [np.bincount(doc[is_hot], weights=t[key], minlength=n) for t in table_]
                tokens = np.bincount(doc, minlength=n)
                # The rest: one row for each document and bigram, with its number there.
                cold = known & ~is_hot
                own = np.sort(doc[cold] * np.int64(voc.size) ** 2 + v[cold] * voc.size + w[cold])  # KNOWN^2 = 2^36 and few documents in a chunk
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(own)))
                d, c = own[first] // np.int64(voc.size) ** 2, own[first] % np.int64(voc.size) ** 2
                # With a tail word: that word, and the other one with its side in the last bit (two tail words: the second, negative).
                v, w, doc = v[~known], w[~known], doc[~known]
                (d2, c2, o2), many2 = _distinct(doc, np.where(v < 0, v, w), np.where(v >= 0, v * 2 + 1, np.where(w >= 0, w * 2, w)))
                row = b.column("doc_id").slice(at, n)
                # A document's tokens and hot sums travel as rows of codes of their own, the sums as the bits of a double.
                key = (mix(row.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)) >> np.uint64(2)).astype(np.int64) // 3 * 3 + DOCUMENT
                every, none = np.arange(n), np.zeros(3 * n + len(c), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        row.take(pa.array(np.concatenate([every, every, every, d, d2]))),
                        pa.array(np.concatenate([key, key + 1, key + 2, c, c2])),
                        pa.array(np.concatenate([none, o2])),
                        pa.array(np.concatenate([tokens, sums[0].view(np.int64), sums[1].view(np.int64), many * 4 + good[at + d], many2 * 4 + good[at + d2]])),
                    ],
                    names=["doc_id", "code", "other", "n"],
                )

    rows = docs.mapInArrow(run, "doc_id long, code long, other long, n long")
    # n is four times a count, and 0 or 1 (in the target) of a document's bigram, 2 or 3 of a word's count in either model.
    kinds = [(c, F.lit(k).cast("long")) for k, c in ((2, "n"), (3, "n_target"))]
    null = F.lit(None).cast("long").alias("doc_id")
    if voc.tail:
        second = tails.join(words, F.col("w") == F.col("key"))
        for c, k in kinds:
            rows = rows.unionByName(words.select(null, F.col("key").alias("code"), F.lit(WORD).cast("long").alias("other"), (F.col(c) * 4 + k).alias("n")))
            rows = rows.unionByName(second.select(null, F.col("v").alias("code"), F.col("w").alias("other"), (F.col(c) * 4 + k).alias("n")))
    rows = rows.repartition("code").sortWithinPartitions("code")  # by one long, which Spark sorts by its digits; what follows is arrays of whole codes

    def of_known(code: np.ndarray, n: np.ndarray, counts: tuple | None = None) -> list[np.ndarray]:
        """Both models' losses of rows of pairs of known words; counts: those of their only pair, where not all of its rows are here."""
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        many, v, w = n >> 2, code[first] // voc.size, code[first] % voc.size
        rows_of = np.diff(np.append(first, len(code)))
        c = counts or (np.add.reduceat(many, first), np.add.reduceat(many * (n & 1), first))
        return [many * np.repeat(voc.loss(c[m], voc.unigram[m][v], voc.unigram[m][w], m), rows_of) for m in (0, 1)]

    def of_tail(code: np.ndarray, other: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Both models' losses of rows with a tail word, 0 for those that hold a word's counts."""
        order = np.lexsort((other, code))
        x, o, many, kind = code[order], other[order], n[order] >> 2, n[order] & 3
        new_word = np.concatenate([[True], x[1:] != x[:-1]])
        new = new_word | np.concatenate([[True], o[1:] != o[:-1]])
        words, first = np.flatnonzero(new_word), np.flatnonzero(new)
        word, pair, o1 = np.cumsum(new_word)[first] - 1, np.cumsum(new) - 1, o[first]
        total = lambda ok, at: np.add.reduceat(np.where(ok, many, 0), at)
        both_tail, side, id_ = o1 < 0, o1 & 1 == 1, np.where((o1 < 0) | (o1 == WORD), 0, o1 >> 1)
        out = []
        for m in (0, 1):
            u, t, c = total((o == WORD) & (kind == 2 + m), words)[word], total((o < 0) & (kind == 2 + m), first), total(kind == 1 if m else kind < 2, first)
            known = voc.unigram[m][id_]
            loss = voc.loss(c, np.where(both_tail | ~side, u, known), np.where(both_tail, t, np.where(side, u, known)), m)
            back = np.empty(len(n))
            back[order] = np.where(kind < 2, many * loss[pair], 0)
            out.append(back)
        return out

    def scored(b: pa.RecordBatch, counts: tuple | None = None) -> pa.RecordBatch:
        """Tokens and both sums for each row of whole codes that is a document's."""
        code, other, n = (b.column(c).to_numpy() for c in ("code", "other", "n"))
        a, z = np.searchsorted(code, [0, DOCUMENT])  # tail words, known words, documents
        kind, bits = (code[z:] - DOCUMENT) % 3, np.ascontiguousarray(n[z:]).view(np.float64)
        out = [np.where(kind == m + 1, bits, 0) for m in (0, 1)]
        if z > a:
            out = [np.concatenate(x) for x in zip(of_known(code[a:z], n[a:z], counts), out, strict=True)]
        own = np.ones(len(n), bool)
        if a:
            out = [np.concatenate(x) for x in zip(of_tail(code[:a], other[:a], n[:a]), out, strict=True)]
            own[:a] = n[:a] & 3 < 2
        tokens = np.zeros(len(n), np.int64)
        tokens[z:] = np.where(kind == 0, n[z:], 0)
        every = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tokens), *map(pa.array, out)], names=["doc_id", "tokens", "background_sum", "target_sum"])
        return every if own.all() else every.filter(pa.array(own))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, least, file = [], 0, ROWS, None

        def spooled() -> Iterator[pa.RecordBatch]:
            writer.close()
            file.seek(0)
            for b in pa.ipc.open_stream(file):
                yield scored(b, tuple(np.array([c]) for c in counts))
            file.close()

        for b in batches:
            if file:  # the rest of a pair with many rows
                k = int(np.searchsorted(b.column("code").to_numpy(), pair, side="right"))
                if k:
                    counts = [c + x for c, x in zip(counts, spool(writer, b.slice(0, k)), strict=True)]
                if k == b.num_rows:
                    continue
                yield from spooled()
                b, file = b.slice(k), None
            held.append(b)
            size += b.num_rows
            if size < least:
                continue
            t = pa.concat_batches(held)
            code = t.column("code").to_numpy()
            last = code[-1]
            cut = size if last >= DOCUMENT else int(np.searchsorted(code, last))
            if cut:
                yield scored(t.slice(0, cut))
            held, size, least = [t.slice(cut)] if cut < size else [], size - cut, ROWS
            if size > ROWS // 2:
                if 0 <= last:  # a pair may have as many rows as there are documents: they wait on disk
                    file, pair = tempfile.TemporaryFile(), last
                    writer = pa.ipc.new_stream(file, t.schema)
                    counts = spool(writer, held[0])
                    held, size = [], 0
                else:  # a tail word has less than 1 / KNOWN of all tokens
                    least = 2 * size
        if file:
            yield from spooled()
        if size:
            yield scored(pa.concat_batches(held))

    def spool(writer: pa.ipc.RecordBatchStreamWriter, b: pa.RecordBatch) -> list[int]:
        """Write rows of a pair of known words; their counts in either model."""
        writer.write_batch(b)
        n = b.column("n").to_numpy()
        return [int((n >> 2).sum()), int(((n >> 2) * (n & 1)).sum())]

    both = rows.mapInArrow(losses, "doc_id long, tokens long, background_sum double, target_sum double")
    per = both.groupBy("doc_id").agg(F.sum("tokens").alias("n_tokens"), F.sum("background_sum").alias("b"), F.sum("target_sum").alias("t"))
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).otherwise(0.0)
    per = per.select("doc_id", "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    return per.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def target_sample(labels: DataFrame) -> DataFrame:
    """The ids of all documents of label quality = 1."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def lm_query(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), target_sample(table(spark, sf_dir, "labels")))
