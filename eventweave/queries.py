"""The engine's registered queries over the events table, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, standard_events
from .functions.conditions import (
    AndCondition, EqCondition, GreaterThanCondition, GreaterThanEqCondition, KCCrossCondition, KCIndexCondition, KCValueCondition, NotEqCondition, OrCondition,
    SimpleCondition, SmallerThanCondition, SmallerThanEqCondition, Var,
)
from .functions import conditions as _cond
from .plans import parallel, statistics
from .plans.pattern import And, Event, Kleene, Not, Or, Pattern, Policy, Seq

A, B, C_ = Event("signup", "a"), Event("purchase", "b"), Event("click", "c")
R, V = Event("error", "r"), Event("view", "v")
H = timedelta(hours=1)
EQ = _cond._OPS["="]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard_events(spark.read.parquet(f"{sf_dir}/events.parquet"), seq="event_id")


def same(*names: str) -> list[EqCondition]:
    """All events are of one user."""
    return [EqCondition(Var(names[0], "user_id"), Var(n, "user_id")) for n in names[1:]]


def pattern(structure, *conditions, window: timedelta, **more) -> Pattern:
    return Pattern(structure, AndCondition(*conditions), window, **more)


def found(p: Pattern | list[Pattern], columns: dict[str, str], prepare: Callable[[DataFrame], DataFrame] | None = None, **engine) -> Callable:
    """A query: the matches' columns (name -> SQL expression over the engine's columns)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir)
        df = prepare(df) if prepare else df
        return Engine(p, **engine).run(df).selectExpr(*[f"{x} AS {n}" for n, x in columns.items()])

    return query


IDS = {"a_id": "a__seq", "b_id": "b__seq"}
SEQ_AB = {**IDS, "user_id": "a__user_id", "a_value": "a__value", "b_value": "b__value"}
IDS3 = {"v_id": "v__seq", "c_id": "c__seq", "b_id": "b__seq"}


def ev(alias: str, kind: str) -> str:
    return f"(SELECT event_id AS id, epoch_us(ts) AS us, user_id, value, props FROM events WHERE event_type = '{kind}') {alias}"


def us(hours: float) -> int:
    return int(hours * 3_600_000_000)


def sql(select: str, tables: list[tuple[str, str]], where: str) -> str:
    return f"SELECT {select} FROM {', '.join(ev(a, k) for a, k in tables)} WHERE {where}"


AB = [("a", "signup"), ("b", "purchase")]
SEL_AB = "a.id AS a_id, b.id AS b_id, a.user_id AS user_id, a.value AS a_value, b.value AS b_value"
KEYED_AB = f"a.user_id = b.user_id AND a.us <= b.us AND b.us - a.us <= {us(24)}"
VCB = [("v", "view"), ("c", "click"), ("b", "purchase")]
SEL_VCB = "v.id AS v_id, c.id AS c_id, b.id AS b_id"
KEYED_VCB = f"v.user_id = c.user_id AND v.user_id = b.user_id AND v.us <= c.us AND c.us <= b.us AND b.us - v.us <= {us(12)}"


def not_exists(where: str, kind: str = "error", alias: str = "r") -> str:
    return f"NOT EXISTS (SELECT 1 FROM {ev(alias, kind)} WHERE {where})"


def spread(*aliases: str, hours: float = 24) -> str:
    times = ", ".join(f"{a}.us" for a in aliases)
    return f"greatest({times}) - least({times}) <= {us(hours)}"


MIDDLE = not_exists(f"r.user_id = a.user_id AND r.us >= a.us AND r.us <= b.us AND {spread('a', 'b', 'r')}")
LEADING = not_exists(f"r.user_id = a.user_id AND r.us <= a.us AND {spread('a', 'b', 'r')}")
TRAILING = not_exists(f"r.user_id = a.user_id AND r.us >= b.us AND {spread('a', 'b', 'r')}")
ANYWHERE = not_exists(f"r.user_id = a.user_id AND {spread('a', 'b', 'r')}")

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Callable, oracle: str | None = None) -> None:
    Q[name] = query
    if oracle:
        SQL[name] = oracle


D = 24 * H
seq_ab = pattern(Seq(A, B), *same("a", "b"), window=D)
seq_vcb = pattern(Seq(V, C_, B), *same("v", "c", "b"), window=12 * H)

register("leaf_filter", found(pattern(Seq(B), GreaterThanCondition(Var("b", "value"), 50.0), window=H), {"b_id": "b__seq", "user_id": "b__user_id", "value": "b__value"}),
         "SELECT event_id AS b_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50.0")
register("seq2_keyed", found(seq_ab, SEQ_AB), sql(SEL_AB, AB, KEYED_AB))
register("seq3_keyed", found(seq_vcb, IDS3), sql(SEL_VCB, VCB, KEYED_VCB))
register("seq2_global_bucketed", found(pattern(Seq(A, B), window=H / 2), IDS), sql("a.id AS a_id, b.id AS b_id", AB, f"a.us <= b.us AND b.us - a.us <= {us(0.5)}"))
P1, P2 = Event("purchase", "a"), Event("purchase", "b")
PP = [("a", "purchase"), ("b", "purchase")]
register("seq_same_type", found(pattern(Seq(P1, P2), *same("a", "b"), SmallerThanCondition(Var("a", "value"), Var("b", "value")), window=D), SEQ_AB),
         sql(SEL_AB, PP, KEYED_AB + " AND a.id <> b.id AND a.value < b.value"))
register("and2_keyed", found(pattern(And(A, B), *same("a", "b"), window=D), SEQ_AB), sql(SEL_AB, AB, f"a.user_id = b.user_id AND {spread('a', 'b')}"))
register("and3", found(pattern(And(V, C_, B), *same("v", "c", "b"), window=6 * H), IDS3),
         sql(SEL_VCB, VCB, f"v.user_id = c.user_id AND v.user_id = b.user_id AND {spread('v', 'c', 'b', hours=6)}"))
relops = [
    SmallerThanEqCondition(Var("a", "value"), Var("b", "value")), GreaterThanEqCondition(Var("b", "value"), 10.0), NotEqCondition(Var("a", "user_id"), Var("b", "user_id")),
    GreaterThanCondition(90.0, Var("a", "value")),
]
register("cond_binary_relops", found(pattern(Seq(A, B), *relops, window=H / 4), IDS),
         sql("a.id AS a_id, b.id AS b_id", AB, f"a.us <= b.us AND b.us - a.us <= {us(0.25)} AND a.value <= b.value AND b.value >= 10.0 AND a.user_id <> b.user_id AND 90.0 > a.value"))
register("cond_or_cross", found(pattern(Seq(A, B), OrCondition(EqCondition(Var("a", "user_id"), Var("b", "user_id")), GreaterThanCondition(Var("a", lambda e: e.value - 40.0), Var("b", "value"))), window=H / 2), IDS),
         sql("a.id AS a_id, b.id AS b_id", AB, f"a.us <= b.us AND b.us - a.us <= {us(0.5)} AND (a.user_id = b.user_id OR a.value - 40.0 > b.value)"))
total = SimpleCondition(Var("v", "value"), Var("c", "value"), Var("b", "value"), relation_op=lambda x, y, z: x + y > z)
register("cond_nary_expr", found(pattern(Seq(V, C_, B), *same("v", "c", "b"), total, window=12 * H), IDS3), sql(SEL_VCB, VCB, KEYED_VCB + " AND v.value + c.value > b.value"))
chain = SimpleCondition(Var("v", "value"), Var("c", "value"), Var("b", "value"), relation_op=lambda x, y, z: x < y < z)
register("cond_python_logic", found(pattern(Seq(V, C_, B), *same("v", "c", "b"), chain, window=12 * H), IDS3), sql(SEL_VCB, VCB, KEYED_VCB + " AND v.value < c.value AND c.value < b.value"))
register("seq_contiguous", found(pattern(Seq(A, B), window=D, policy=Policy(contiguous=["a", "b"])), IDS), sql("a.id AS a_id, b.id AS b_id", AB, f"a.us <= b.us AND b.us - a.us <= {us(24)} AND a.id = b.id - 1"))

user_r = EqCondition(Var("a", "user_id"), Var("r", "user_id"))
for name, args, extra in (
    ("not_middle", (A, Not(R), B), MIDDLE), ("not_leading", (Not(R), A, B), LEADING), ("not_trailing", (A, B, Not(R)), TRAILING),
):
    register(name, found(pattern(Seq(*args), *same("a", "b"), user_r, window=D), SEQ_AB), sql(SEL_AB, AB, f"{KEYED_AB} AND {extra}"))
later = not_exists(f"v.user_id = a.user_id AND v.us >= b.us AND {spread('a', 'b', 'v')}", "view", "v")
register("not_multiple", found(pattern(Seq(A, Not(R), B, Not(V)), *same("a", "b"), user_r, EqCondition(Var("a", "user_id"), Var("v", "user_id")), window=D), SEQ_AB),
         sql(SEL_AB, AB, f"{KEYED_AB} AND {MIDDLE} AND {later}"))
register("not_in_and", found(pattern(And(A, Not(R), B), *same("a", "b"), user_r, window=D), SEQ_AB), sql(SEL_AB, AB, f"a.user_id = b.user_id AND {spread('a', 'b')} AND {ANYWHERE}"))
inner = f"NOT EXISTS (SELECT 1 FROM {ev('v', 'view')}, {ev('c', 'click')} WHERE v.user_id = a.user_id AND c.user_id = a.user_id AND v.us <= c.us AND v.us >= a.us AND c.us <= b.us AND {spread('a', 'b', 'v', 'c')})"
register("not_over_seq", found(pattern(Seq(A, Not(Seq(V, C_)), B), *same("a", "b"), EqCondition(Var("v", "user_id"), Var("c", "user_id")), EqCondition(Var("a", "user_id"), Var("v", "user_id")), window=D), SEQ_AB),
         sql(SEL_AB, AB, f"{KEYED_AB} AND {inner}"))
early = not_exists(f"v.user_id = a.user_id AND v.us >= a.us AND v.us <= b.us AND {spread('a', 'b', 'v')}", "view", "v")
register("rewrite_not_or", found(pattern(Seq(A, Not(Or(R, V)), B), *same("a", "b"), user_r, EqCondition(Var("a", "user_id"), Var("v", "user_id")), window=D), SEQ_AB),
         sql(SEL_AB, AB, f"{KEYED_AB} AND {MIDDLE} AND {early}"))
register("or_union", found(pattern(Seq(A, Or(B, C_)), *same("a", "b"), EqCondition(Var("a", "user_id"), Var("c", "user_id")), window=12 * H), {"a_id": "a__seq", "b_id": "b__seq", "c_id": "c__seq"}),
         sql("a.id AS a_id, b.id AS b_id, NULL::BIGINT AS c_id", AB, f"a.user_id = b.user_id AND a.us <= b.us AND b.us - a.us <= {us(12)}") + " UNION ALL "
         + sql("a.id AS a_id, NULL::BIGINT AS b_id, c.id AS c_id", [("a", "signup"), ("c", "click")], f"a.user_id = c.user_id AND a.us <= c.us AND c.us - a.us <= {us(12)}"))

register("rewrite_and_and", found(pattern(And(V, And(C_, B)), *same("v", "c", "b"), window=6 * H), IDS3),
         sql(SEL_VCB, VCB, f"v.user_id = c.user_id AND v.user_id = b.user_id AND {spread('v', 'c', 'b', hours=6)}"))
register("rewrite_not_not", found(pattern(Seq(V, Not(Not(C_)), B), *same("v", "c", "b"), window=12 * H), IDS3), sql(SEL_VCB, VCB, KEYED_VCB))
register("negatives_by_rate", found(pattern(Seq(A, Not(R), Not(V), B), *same("a", "b"), user_r, EqCondition(Var("a", "user_id"), Var("v", "user_id")), window=D), SEQ_AB, planner="greedy",
                                    rates={"signup": 1.0, "purchase": 1.0, "error": 1.0, "view": 5.0}), sql(SEL_AB, AB, f"{KEYED_AB} AND {MIDDLE} AND {early}"))

# Kleene closures: unrolled self-joins up to the largest size.
KC = Kleene(Event("purchase", "p"), 1, 3)
one_user = KCIndexCondition("p", "user_id", EQ, offset=-1)
LIST = {"ids": "array_join(transform(p, x -> cast(x.seq as string)), ',')", "n": "cast(size(p) as bigint)"}


def unrolled(hours: float, extra: dict[int, str], least: int = 1, most: int = 3) -> str:
    out = []
    for n in range(least, most + 1):
        p = [f"p{i}" for i in range(n)]
        where = ["TRUE", *[f"p{i}.user_id = p{i + 1}.user_id AND p{i}.id < p{i + 1}.id" for i in range(n - 1)], f"p{n - 1}.us - p0.us <= {us(hours)}", extra.get(n, "TRUE")]
        ids = " || ',' || ".join(f"CAST({x}.id AS VARCHAR)" for x in p)
        out.append(sql(f"{ids} AS ids, CAST({n} AS BIGINT) AS n", [(x, "purchase") for x in p], " AND ".join(where)))
    return " UNION ALL ".join(out)


register("kleene_minmax", found(pattern(KC, one_user, window=D), LIST), unrolled(24, {}))
register("kleene_value_cond", found(pattern(KC, one_user, KCValueCondition("p", "value", lambda x, y: x > y, 30.0), window=D), LIST),
         unrolled(24, {n: " AND ".join(f"p{i}.value > 30.0" for i in range(n)) for n in (1, 2, 3)}))
register("kleene_index_cond", found(pattern(KC, one_user, KCIndexCondition("p", "value", lambda x, y: x < y, first_index=0, second_index=1), window=D), LIST),
         unrolled(24, {1: "FALSE", 2: "p0.value < p1.value", 3: "p0.value < p1.value"}))
register("kleene_offset_cond", found(pattern(KC, one_user, KCIndexCondition("p", "value", lambda x, y: x < y, offset=1), window=D), LIST),
         unrolled(24, {1: "FALSE", 2: "p0.value < p1.value", 3: "p0.value < p1.value AND p1.value < p2.value"}))
with_list = pattern(Seq(A, Kleene(Event("purchase", "p"), 1, 2), C_), *same("a", "c"), one_user, KCCrossCondition("p", "user_id", EQ, Var("a", "user_id")), window=D)
register("seq_with_kleene", found(with_list, {"a_id": "a__seq", "c_id": "c__seq", **LIST}),
         " UNION ALL ".join(sql(f"a.id AS a_id, c.id AS c_id, {ids} AS ids, CAST({n} AS BIGINT) AS n", [("a", "signup"), *ps, ("c", "click")],
                                f"a.user_id = c.user_id AND {cond} AND c.us - a.us <= {us(24)}")
                            for n, ids, ps, cond in (
                                (1, "CAST(p.id AS VARCHAR)", [("p", "purchase")], "p.user_id = a.user_id AND a.us <= p.us AND p.us <= c.us"),
                                (2, "CAST(p.id AS VARCHAR) || ',' || CAST(q.id AS VARCHAR)", [("p", "purchase"), ("q", "purchase")],
                                 "p.user_id = a.user_id AND q.user_id = a.user_id AND p.id < q.id AND a.us <= p.us AND q.us <= c.us"))))

W4 = {"a_id": "a__seq", "b_id": "b__seq", "v_id": "v__seq", "c_id": "c__seq"}
SEL4, T4 = "a.id AS a_id, b.id AS b_id, v.id AS v_id, c.id AS c_id", [*AB, ("v", "view"), ("c", "click")]
ONE4 = "a.user_id = b.user_id AND a.user_id = v.user_id AND a.user_id = c.user_id"
register("nested_and_of_seq", found(pattern(And(Seq(A, B), Seq(V, C_)), *same("a", "b", "v", "c"), window=6 * H), W4), sql(SEL4, T4, f"{ONE4} AND a.us <= b.us AND v.us <= c.us AND {spread('a', 'b', 'v', 'c', hours=6)}"))
register("nested_seq_of_and", found(pattern(Seq(A, And(V, C_), B), *same("a", "b", "v", "c"), window=12 * H), W4),
         sql(SEL4, T4, f"{ONE4} AND a.us <= v.us AND a.us <= c.us AND v.us <= b.us AND c.us <= b.us AND b.us - a.us <= {us(12)}"))

register("match_single_one_type", found(pattern(Seq(A, B), *same("a", "b"), window=D, policy=Policy(single="signup")), IDS),
         f"SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY greatest(a_id, b_id), a_id, b_id) AS k FROM ({sql(SEL_AB, AB, KEYED_AB)})) WHERE k = 1")
pairs = sql("v.id AS v_id, c.id AS c_id, v.us AS v_us, c.us AS c_us, v.user_id AS user_id", VCB[:2], f"v.user_id = c.user_id AND v.us <= c.us AND c.us - v.us <= {us(12)}")
register("match_next_one_type", found(pattern(Seq(V, C_, B), *same("v", "c", "b"), window=12 * H, policy=Policy(single="view", secondary="next")), IDS3),
         f"WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v_id ORDER BY greatest(v_id, c_id), c_id) AS k FROM ({pairs})) WHERE k = 1), "
         f"t AS (SELECT v_id, c_id, b.id AS b_id FROM p, {ev('b', 'purchase')} WHERE b.user_id = p.user_id AND c_us <= b.us AND b.us - v_us <= {us(12)}) "
         "SELECT v_id, c_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY v_id ORDER BY b_id, c_id) AS k FROM t) WHERE k = 1")  # fmt: skip
# Going through all matches in their order: one is kept if none of its events is taken.
register("match_single_all", found(pattern(Seq(A, B), *same("a", "b"), window=D, policy=Policy(primary="single")), IDS),
         f"WITH RECURSIVE m AS (SELECT a_id, b_id, row_number() OVER (ORDER BY greatest(a_id, b_id), a_id, b_id) AS k FROM ({sql(SEL_AB, AB, KEYED_AB)})), "
         "go(k, taken, a_id, b_id, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false UNION ALL "
         "SELECT m.k, CASE WHEN list_has_any(taken, [m.a_id, m.b_id]) THEN taken ELSE list_concat(taken, [m.a_id, m.b_id]) END, m.a_id, m.b_id, NOT list_has_any(taken, [m.a_id, m.b_id]) "
         "FROM go JOIN m ON m.k = go.k + 1) SELECT a_id, b_id FROM go WHERE kept")  # fmt: skip
# A signup that is taken up stops further ones until its first match, or for the length of the window.
register("freeze", found(pattern(Seq(A, B), *same("a", "b"), window=D, policy=Policy(freeze="a")), IDS),
         f"WITH RECURSIVE m AS ({sql(SEL_AB, AB, KEYED_AB)}), s AS (SELECT a.id, a.us, min(m.b_id) AS b FROM {ev('a', 'signup')} LEFT JOIN m ON m.a_id = a.id GROUP BY a.id, a.us), "
         f"step AS (SELECT x.id, min(y.id) AS n FROM s x JOIN s y ON y.id > x.id AND (y.id > x.b OR y.us - x.us > {us(24)}) GROUP BY x.id), "
         "live(id) AS (SELECT min(id) FROM s UNION ALL SELECT step.n FROM live JOIN step ON step.id = live.id) SELECT a_id, b_id FROM m WHERE a_id IN (SELECT id FROM live)")  # fmt: skip


def with_prob(df: DataFrame) -> DataFrame:
    return df.withColumn("prob", F.expr("least(abs(value) / 200.0 + 0.5, 1.0)"))


PROB = "least(abs({0}.value) / 200.0 + 0.5, 1.0)"
both = f"{PROB.format('a')} * {PROB.format('b')}"
register("prob_seq", found(pattern(Seq(A, B), *same("a", "b"), window=D, confidence=0.5), {**IDS, "prob": "round(match_prob, 12)"}, with_prob),
         f"SELECT a_id, b_id, round(p, 12) AS prob FROM ({sql(f'a.id AS a_id, b.id AS b_id, {both} AS p', AB, KEYED_AB)}) WHERE p >= 0.5")
fits = f"r.user_id = a.user_id AND r.us >= a.us AND r.us <= b.us AND {spread('a', 'b', 'r')}"
register("prob_not", found(pattern(Seq(A, Not(R), B), *same("a", "b"), user_r, window=D, confidence=0.2), {**IDS, "prob": "round(match_prob, 12)"}, with_prob),
         "WITH n AS (SELECT a_id, b_id, p0, count(r_id) AS k, product(CASE WHEN r_id IS NULL THEN 1.0 ELSE 1 - pr END) AS q FROM (SELECT a.id AS a_id, b.id AS b_id, " + both + f" AS p0, r.id AS r_id, {PROB.format('r')} AS pr "
         f"FROM {ev('a', 'signup')} JOIN {ev('b', 'purchase')} ON {KEYED_AB} LEFT JOIN (SELECT * FROM {ev('r0', 'error')} WHERE {PROB.format('r0')} >= 0.2) r ON {fits}) GROUP BY a_id, b_id, p0) "
         "SELECT a_id, b_id, round(p0 * q, 12) AS prob FROM n WHERE p0 >= 0.2 AND p0 * q >= 0.2")  # fmt: skip

multi = [pattern(Seq(A, B), *same("a", "b"), window=D), pattern(Seq(A, B), *same("b", "a"), window=6 * H), pattern(Seq(V, C_), *same("v", "c"), window=6 * H)]
register("multi_pattern", found(multi, {"pattern_id": "pattern_id", "a_id": "a__seq", "b_id": "b__seq", "v_id": "v__seq", "c_id": "c__seq"}),
         " UNION ALL ".join(sql(f"CAST({i} AS INTEGER) AS pattern_id, a.id AS a_id, b.id AS b_id, NULL::BIGINT AS v_id, NULL::BIGINT AS c_id", AB, f"a.user_id = b.user_id AND a.us <= b.us AND b.us - a.us <= {us(h)}") for i, h in ((1, 24), (2, 6)))
         + " UNION ALL " + sql("CAST(3 AS INTEGER) AS pattern_id, NULL::BIGINT AS a_id, NULL::BIGINT AS b_id, v.id AS v_id, c.id AS c_id", [("v", "view"), ("c", "click")], f"v.user_id = c.user_id AND v.us <= c.us AND c.us - v.us <= {us(6)}"))
VC = Seq(V, C_)
parts = [pattern(Seq(V, C_, B), *same("v", "c", "b"), window=12 * H), pattern(And(VC, A), *same("v", "c"), EqCondition(Var("v", "user_id"), Var("a", "user_id")), window=6 * H), pattern(VC, *same("v", "c"), window=2 * H)]
NEAR_A = f"v.user_id = c.user_id AND v.user_id = a.user_id AND v.us <= c.us AND greatest(c.us, a.us) - least(v.us, a.us) <= {us(6)}"
for share in ("subtrees", "tabu", "annealing"):
    register(f"multi_pattern_{share}", found(parts, {"pattern_id": "pattern_id", "v_id": "v__seq", "c_id": "c__seq", "b_id": "b__seq", "a_id": "a__seq"}, share=share),
             sql("CAST(1 AS INTEGER) AS pattern_id, v.id AS v_id, c.id AS c_id, b.id AS b_id, NULL::BIGINT AS a_id", VCB, KEYED_VCB)
             + " UNION ALL " + sql("CAST(2 AS INTEGER) AS pattern_id, v.id AS v_id, c.id AS c_id, NULL::BIGINT AS b_id, a.id AS a_id", [*VCB[:2], ("a", "signup")], NEAR_A)
             + " UNION ALL " + sql("CAST(3 AS INTEGER) AS pattern_id, v.id AS v_id, c.id AS c_id, NULL::BIGINT AS b_id, NULL::BIGINT AS a_id", VCB[:2], f"v.user_id = c.user_id AND v.us <= c.us AND c.us - v.us <= {us(2)}"))
RATES = {"signup": 1.0, "purchase": 3.0, "click": 2.0, "view": 5.0, "error": 1.0}
for planner in ("greedy", "dynamic_bushy", "ascending_frequency", "iterative_improvement", "dynamic_left_deep", "zstream", "zstream_ordered", "greedy_invariant", "zstream_invariant"):
    register(f"seq3_plan_{planner}", found(seq_vcb, IDS3, planner=planner, rates=RATES), sql(SEL_VCB, VCB, KEYED_VCB))

register("arrival_rates", lambda spark, d: statistics.arrival_rates(events(spark, d)).select("event_type", "n", F.round("rate", 9).alias("rate")),
         "SELECT event_type, count(*) AS n, round(count(*) * 1e6 / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events), 9) AS rate FROM events GROUP BY event_type")
register("own_selectivity", lambda spark, d: statistics.own_selectivity(events(spark, d), "purchase", "b", GreaterThanCondition(Var("b", "value"), 50.0)).select("events", F.round("selectivity", 9).alias("selectivity")),
         "SELECT count(*) AS events, round(avg(CASE WHEN value > 50.0 THEN 1.0 ELSE 0.0 END), 9) AS selectivity FROM events WHERE event_type = 'purchase'")
register("pair_selectivity", lambda spark, d: statistics.selectivity(events(spark, d), ("signup", "a"), ("purchase", "b"), SmallerThanCondition(Var("a", "value"), Var("b", "value"))).select("pairs", F.round("selectivity", 9).alias("selectivity")),
         f"SELECT count(*) AS pairs, round(avg(CASE WHEN a.value < b.value THEN 1.0 ELSE 0.0 END), 9) AS selectivity FROM {ev('a', 'signup')}, {ev('b', 'purchase')} WHERE a.us // {us(1)} = b.us // {us(1)}")


def dealt(run: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda spark, d: run(events(spark, d)).selectExpr(*[f"{x} AS {n}" for n, x in SEQ_AB.items()])


register("group_by_key_seq", dealt(lambda e: parallel.by_key(e, seq_ab, "user_id", 8)), sql(SEL_AB, AB, KEYED_AB))
register("rip_seq", dealt(lambda e: parallel.by_time(e, seq_ab, timedelta(days=3))), sql(SEL_AB, AB, KEYED_AB))
register("hypercube_seq", dealt(lambda e: parallel.hypercube(e, seq_ab, {"signup": "user_id", "purchase": "value"}, [3, 2])), sql(SEL_AB, AB, KEYED_AB))
k_of = lambda e: F.get_json_object(e.props, "$.k").cast("long")
register("json_props_cond", found(pattern(Seq(A, B), *same("a", "b"), SmallerThanCondition(Var("a", k_of), Var("b", k_of)), window=D), SEQ_AB),
         sql(SEL_AB, AB, KEYED_AB + " AND CAST(json_extract_string(a.props, '$.k') AS BIGINT) < CAST(json_extract_string(b.props, '$.k') AS BIGINT)"))


def streamed(p: Pattern, columns: dict[str, str]) -> Callable:
    """The pattern over events as a stream, run until all of them are read; the matches that are then certain."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from uuid import uuid4

        from .operators.storage import shared_dir
        from .streaming.match import stream_matches

        raw = spark.read.parquet(f"{sf_dir}/events.parquet")
        stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        stream = standard_events(stream, seq="event_id").withColumn("ts", F.col("ts").cast("timestamp"))
        place = f"{shared_dir(spark)}/matches-{uuid4().hex}"  # matches go to files, never to the driver
        out = stream_matches(stream, p).selectExpr(*[f"{x} AS {n}" for n, x in columns.items()])
        run = out.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{place}/rows")

    return query


register("stream_seq2_keyed", streamed(seq_ab, SEQ_AB), sql(SEL_AB, AB, KEYED_AB))
register("stream_and2_keyed", streamed(pattern(And(A, B), *same("a", "b"), window=D), SEQ_AB), sql(SEL_AB, AB, f"a.user_id = b.user_id AND {spread('a', 'b')}"))
