"""Personal data by weak supervision, in DataFrame expressions only.

Four labelers (a strict regex check, gazetteers, the words around, the characters at both ends) vote on every candidate
span: 1 for personal data, -1 against, 0 no opinion. Expectation-maximisation over the counts of the vote patterns
estimates how reliable each labeler is for each kind, and its posteriors train a logistic span classifier on votes and
span shape. Both fits see a count for each distinct pattern (at most KINDS x 3^4 x 2^3 rows), so the driver holds a
bounded table however large the corpus is. The classifier is applied as a column expression.

Spans of the base kinds (email, ip, card, phone) that pass their check always stay. The classifier decides on the
further kinds: account (16 to 19 digits that fail the Luhn check), contact (obfuscated addresses and phone numbers
without a country code) and secret (long mixed tokens).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save, table

KINDS = ["email", "ip", "card", "phone", "account", "contact", "secret"]
BASE = KINDS[:4]
#: Values that one fold goes through; longer arrays are folded in blocks.
STEPS = 64
#: Characters of the pieces that a text is cut to for masking.
PIECE = 256

# Patterns as Java regular expressions. Possessive quantifiers and the look-behind stop them from scanning a long run
# again from each of its characters; they match what the plain form matches.
_LOCAL = "[A-Za-z0-9._%+-]"
_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": _RUN,
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]++)++"
    r"|(?<![0-9+().-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{24,}+(?![A-Za-z0-9_@.-])",
}
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "contact": "[\\[(]at[\\])]|[0-9]{3}[.-][0-9]{4}", "secret": "[A-Za-z0-9_-]{24}"}

# Top-level domains, card issuer prefixes, country calling codes, and words around personal data.
TLDS = "com org net edu gov mil int info biz io co de fr es it uk us eu nl be ch at pt pl se no dk fi ie ca au nz jp cn in br mx ru"
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)"
CALLING = "^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|24|25|26|29|35|37|38|42|50|59|67|68|69|80|85|87|88|96|97|99)"
FOR = "(?i)(mail|contact|phone|tel|call|fax|mobile|card|visa|account|konto|iban|address|adresse|server|host|login|token|key|secret|password|api)"
AGAINST = "(?i)(isbn|issn|version|order|invoice|chapter|page|article|doi|license)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array of integers, those before it combined by op (a sum or a maximum; 0 before the first).

    A fold that appends to one array copies it at each step. This one runs over blocks of STEPS values and, level by level, over
    what the blocks come to, so that its work is the number of values times a constant.
    """

    def run(xs: Column, start: Column) -> Column:
        zero = F.struct(start.alias("s"), F.slice(F.array(start), 1, 0).alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(op(acc["s"], x).alias("s"), F.array_append(acc["out"], acc["s"]).alias("out")), lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / STEPS).cast("int") - 1), lambda i: F.slice(xs, i * STEPS + 1, F.lit(STEPS)))

    zero = F.lit(0)

    def whole(bs: Column) -> Column:
        return F.aggregate(bs, zero, op)

    def level(xs: Column, depth: int) -> Column:
        if not depth:
            return run(xs, zero)
        deep = _once(blocks(xs), lambda bs: F.flatten(F.zip_with(bs, level(F.transform(bs, whole), depth - 1), run)))
        return F.when(F.size(xs) <= STEPS, run(xs, zero)).otherwise(deep)

    return level(values, 2)


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, m>> of all matches, leftmost first: marks go round each match, and the pieces between them are measured."""
    clean = F.translate(text, "\u0001\u0002", "\u0003\u0003")  # of equal length, and no pattern has either
    pieces = F.split(F.regexp_replace(clean, PATTERNS[kind], "\u0001$0\u0002"), "\u0001", -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")

    def span(piece: Column, at: Column) -> Column:
        m = F.substring_index(piece, "\u0002", 1)
        return F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("m"))

    def found(ps: Column) -> Column:
        # The piece before the first match has no mark, each other one has the mark that ends its match.
        sizes = F.transform(ps, lambda p, i: F.length(p) - F.when(i == 0, 0).otherwise(1))
        both = F.zip_with(ps, _once(sizes, lambda v: _before(v, lambda a, b: a + b)), span)
        return F.when(F.size(ps) > 1, F.slice(both, F.lit(2), F.size(ps))).otherwise(none)

    return F.when(text.rlike(_NEEDS[kind]), _once(pieces, found)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.split(F.reverse(_digits(m)), "")

    def worth(c: Column, i: Column) -> Column:
        n = c.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.filter(d, lambda c: c != ""), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _strict(kind: str, m: Column) -> Column:
    """Whether a match passes its kind's check."""
    n = F.length(_digits(m))
    if kind == "ip":
        number = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999))
        return F.forall(F.split(m, "\\."), lambda p: number(p) <= 255)
    if kind == "card":
        return (n >= 16) & (n <= 19) & _luhn(m)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    """1, -1 or 0."""
    yes = lambda c: F.when(c, 1).otherwise(-1)
    if kind == "email":
        return yes(F.lower(F.regexp_extract(m, "\\.([A-Za-z0-9-]+)$", 1)).isin(TLDS.split()))
    if kind == "ip":
        return yes(~m.rlike("^(0|10|127|192\\.168|22[4-9]|23[0-9]|24[0-9]|25[0-9])\\."))
    if kind in ("card", "account"):
        return yes(_digits(m).rlike(ISSUERS))
    if kind == "phone":
        return yes(_digits(m).rlike(CALLING))
    return F.lit(0)


def _candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, v1..v4, f1..f3>> of one text."""

    def rated(kind: str, source: str, keep) -> Column:
        k = KINDS.index(kind)

        def rate(s: Column) -> Column:
            around = F.substring(text, F.greatest(s["start"] - 39, F.lit(1)), F.least(s["start"], F.lit(40)))
            before, after = F.substring(text, s["start"], F.lit(1)), F.substring(text, s["end"] + 1, F.lit(1))
            before = F.when(s["start"] > 0, before).otherwise("")
            glued = before.rlike("[\\p{L}0-9]") | after.rlike("[\\p{L}0-9]")
            strict = _strict(kind, s["m"]) if kind in BASE else F.lit(False)
            regex = F.when(strict, 1).otherwise(-1) if kind in BASE else F.lit(-1 if kind == "account" else 0)
            context = F.when(around.rlike(FOR), 1).when(around.rlike(AGAINST), -1).otherwise(0)
            return F.struct(
                F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), strict.alias("base"),
                regex.alias("v1"), _gazetteer(kind, s["m"]).alias("v2"), context.alias("v3"), F.when(glued, -1).otherwise(1).alias("v4"),
                (s["end"] - s["start"] > 20).cast("int").alias("f1"), s["m"].rlike("[\\x20().-]").cast("int").alias("f2"),
                before.rlike("[\"'=:]").cast("int").alias("f3"),
            )

        return F.transform(F.filter(_spans(text, source), keep) if keep else _spans(text, source), rate)

    parts = [rated(k, k, (lambda s: _luhn(s["m"])) if k == "card" else None) for k in BASE]
    parts += [rated("account", "card", lambda s: ~_luhn(s["m"])), rated("contact", "contact", None), rated("secret", "secret", None)]
    return F.concat(*parts)


Pattern = tuple[int, ...]


def em(counts: dict[Pattern, int], rounds: int = 60) -> dict[Pattern, float]:
    """Posterior of personal data for each pattern (kind, v1..v4), by expectation-maximisation over a naive Bayes model of each kind's votes."""
    post = {p: 1 / (1 + math.exp(-(0.5 + 1.2 * sum(p[1:])))) for p in counts}
    for _ in range(rounds):
        new = {}
        for kind in {p[0] for p in counts}:
            own = [p for p in counts if p[0] == kind]
            total = sum(counts[p] for p in own)
            yes = sum(counts[p] * post[p] for p in own)
            prior = (yes + 2) / (total + 4)
            odds = {p: math.log(prior / (1 - prior)) for p in own}
            for j in range(1, 5):
                for v in (-1, 0, 1):
                    a = sum(counts[p] * post[p] for p in own if p[j] == v)
                    b = sum(counts[p] * (1 - post[p]) for p in own if p[j] == v)
                    # The prior holds each labeler to be better than chance, so that the classes cannot swap names.
                    ratio = math.log((a + 2 + 2 * (v == 1)) / (yes + 8)) - math.log((b + 2 + 2 * (v == -1)) / (total - yes + 8))
                    for p in own:
                        if p[j] == v:
                            odds[p] += ratio
            new |= {p: 1 / (1 + math.exp(-max(-30, min(30, odds[p])))) for p in own}
        post = new
    return post


def _features(p: Pattern) -> list[float]:
    kind, votes, shape = p[0], p[1:5], p[5:]
    return [1.0, *votes, *shape, *(float(kind == k) for k in range(len(KINDS)))]


def train_classifier(counts: dict[Pattern, int], post: dict[Pattern, float], rounds: int = 400) -> list[float]:
    """Weights of a logistic regression of the posteriors on votes, shape and kind, by gradient ascent over the counted patterns."""
    rows = [(_features(p), n, post[p[:5]]) for p, n in counts.items()]
    total = sum(n for _, n, _ in rows) or 1
    w = [0.0] * len(_features((0,) * 8))
    for _ in range(rounds):
        g = [-0.001 * x for x in w]
        for x, n, y in rows:
            err = n / total * (y - 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x, strict=True)))))))
            g = [a + err * b for a, b in zip(g, x, strict=True)]
        w = [a + 1.0 * b for a, b in zip(w, g, strict=True)]
    return w


def _probability(w: list[float], s: Column) -> Column:
    z = F.lit(w[0])
    for j, name in enumerate(["v1", "v2", "v3", "v4", "f1", "f2", "f3"], 1):
        z = z + F.lit(w[j]) * s[name]
    z = z + F.element_at(F.array(*[F.lit(x) for x in w[8:]]), s["kind"] + 1)
    return 1 / (1 + F.exp(-z))


def find_pii(docs: DataFrame, text: str = "text", cut: float = 0.5, keep_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(docs with a column pii more, the saved table behind it).

    pii is array<struct<kind string, start int, end int, base boolean, p double>>: first by kind as listed in KINDS, then by
    start; places count code points, the end is exclusive. A null text is an empty one and has no span.
    Repeated rows are judged each on its own, an empty table gives an empty one,
    and whole texts of any length are read. A column of docs called pii is replaced.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    kept = docs.withColumn("_pii", _candidates(c))
    kept = save(kept if keep_text else kept.drop(text), "pii-candidates")
    names = ["kind", "v1", "v2", "v3", "v4", "f1", "f2", "f3"]
    one = kept.select(F.explode("_pii").alias("s")).select(*[F.col(f"s.{n}").alias(n) for n in names])
    full = {tuple(int(r[n]) for n in names): r["count"] for r in one.groupBy(*names).count().collect()}
    votes: dict[Pattern, int] = {}
    for p, n in full.items():
        votes[p[:5]] = votes.get(p[:5], 0) + n
    w = train_classifier(full, em(votes))
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def final(s: Column) -> Column:
        return F.struct(F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), _probability(w, s).alias("p"))

    further = F.lit(len(BASE))
    chosen = F.filter("_pii", lambda s: s["base"] | ((s["kind"] >= further) & (_probability(w, s) >= cut)))
    return kept.withColumn("pii", F.transform(chosen, final)).drop("_pii"), kept


def _cutter(pieces: Column) -> Callable[[Column, Column], Column]:
    """substring by places (from, to) of a text that lies in pieces of PIECE characters.

    Strings are UTF-8, so a place is found by walking from the beginning: here from that of its piece.
    """

    def cut(lo: Column, hi: Column) -> Column:
        i, j = F.floor(lo / PIECE).cast("int"), F.floor((hi - 1) / PIECE).cast("int")
        ends = F.concat(F.substring(F.get(pieces, i), lo % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(pieces, j), F.lit(1), hi - j * PIECE))
        return F.when(hi <= lo, "").when(i == j, F.substring(F.get(pieces, i), lo % PIECE + 1, hi - lo)).otherwise(ends)

    return cut


def redact(text: Column, pii: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one, named after the first."""
    first = F.array_sort(pii, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))

    def masked(spans: Column, pieces: Column) -> Column:
        cut = _cutter(pieces)
        ends = _before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        open_ = F.zip_with(spans, ends, lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at")))
        # A span that begins before the one before it ends is part of it.
        parts = F.transform(F.filter(open_, lambda s: s["start"] >= s["at"]), lambda s: F.concat(cut(s["at"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), cut(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(pii) > 0, _once(first, lambda spans: _once(pieces, lambda ps: masked(spans, ps)))).otherwise(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    found, _ = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.filter("pii", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def pii_stage(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in text masked; other columns are as they were."""
    found, kept = find_pii(docs, text)
    out = save(found.withColumn(text, F.when(F.col(text).isNotNull(), redact(F.col(text), F.col("pii")))).drop("pii").select(*docs.columns), "pii-masked")
    drop_saved(kept)
    return out
