import random
from datetime import timedelta

import pytest
from brute import evaluate, keys, row_keys

from eventweave.engine import Engine, standard_events
from eventweave.functions.conditions import AndCondition, EqCondition, KCCrossCondition, KCIndexCondition, KCValueCondition, OrCondition, SimpleCondition, SmallerThanCondition, Var
from eventweave.functions.conditions import _OPS
from eventweave.operators.match import Options
from eventweave.operators.storage import cut
from eventweave.plans.pattern import And, Event, Kleene, Not, Pattern, Policy, Seq, bound_names, events_of

A, B, C, D = Event("A", "a"), Event("B", "b"), Event("C", "c"), Event("D", "d")
A2 = Event("A", "a2")
EQ = _OPS["="]
S = 1_000_000


def stream(seed, n=28, span=40, types="ABCD"):
    """Random events in the order of time, with ties."""
    rng = random.Random(seed)
    times = sorted(rng.randrange(span) for _ in range(n))
    return [{"seq": i, "event_type": rng.choice(types), "us": t * S, "k": rng.randrange(2), "x": rng.randrange(10)} for i, t in enumerate(times)]


def frame(spark, events):
    rows = [(e["seq"], e["event_type"], e["us"], e["k"], e["x"]) for e in events]
    return spark.createDataFrame(rows, "seq long, event_type string, us long, k long, x long")


def eq(p, q):
    return EqCondition(Var(p, "k"), Var(q, "k")), ({p, q}, lambda b: b[p]["k"] == b[q]["k"])


def lt(p, q):
    return SmallerThanCondition(Var(p, "x"), Var(q, "x")), ({p, q}, lambda b: b[p]["x"] < b[q]["x"])


either = (
    OrCondition(EqCondition(Var("a", "k"), Var("b", "k")), SmallerThanCondition(Var("a", "x"), Var("b", "x"))),
    ({"a", "b"}, lambda b: b["a"]["k"] == b["b"]["k"] or b["a"]["x"] < b["b"]["x"]),
)
rising = (KCIndexCondition("b", "x", _OPS["<"], offset=1), ({"b"}, lambda m: len(m["b"]) > 1 and all(p["x"] < q["x"] for p, q in zip(m["b"], m["b"][1:], strict=False))))
one_k = (KCIndexCondition("b", "k", EQ, offset=-1), ({"b"}, lambda m: len({e["k"] for e in m["b"]}) == 1))
large = (KCValueCondition("b", "x", lambda p, q: p > q, 3), ({"b"}, lambda m: all(e["x"] > 3 for e in m["b"])))
second = (KCIndexCondition("b", "x", lambda p, q: p != q, first_index=0, second_index=1), ({"b"}, lambda m: len(m["b"]) > 1 and m["b"][0]["x"] != m["b"][1]["x"]))
cross = (KCCrossCondition("b", "k", EQ, Var("a", "k")), ({"a", "b"}, lambda m: all(e["k"] == m["a"]["k"] for e in m["b"])))
pairs_rise = (KCIndexCondition({"a", "b"}, "x", _OPS["<"], offset=2), ({"kc_a_b"}, lambda m: len(m["kc_a_b"]) > 2 and all(p["x"] < q["x"] for p, q in zip(m["kc_a_b"], m["kc_a_b"][2:], strict=False))))

CASES = {
    "seq": (Seq(A, B), [], 5),
    "seq keyed": (Seq(A, B, C), [eq("a", "b"), lt("b", "c")], 12),
    "seq one type": (Seq(A, A2), [lt("a", "a2")], 6),
    "and": (And(A, B, A2), [eq("a", "b")], 5),
    "or condition": (Seq(A, B), [either], 8),
    "not middle": (Seq(A, Not(C), B), [eq("a", "b")], 9),
    "not middle of one type": (Seq(A, Not(A2), B), [lt("a", "a2")], 9),
    "not leading": (Seq(Not(C), A, B), [lt("c", "a")], 8),
    "not trailing": (Seq(A, B, Not(C)), [eq("c", "b")], 8),
    "nots": (Seq(Not(C), A, Not(D), B), [eq("d", "b")], 6),
    "not in and": (And(A, Not(C), B), [lt("c", "b")], 6),
    "not over seq": (Seq(A, Not(Seq(C, D)), B), [lt("c", "d")], 12),
    "nested": (And(Seq(A, B), Seq(C, D)), [eq("a", "c")], 7),
    "nested not": (Seq(A, And(C, Not(D)), B), [eq("a", "b")], 9),
    "seq of and": (Seq(A, And(C, D), B), [eq("c", "d")], 12),
    "kleene": (Kleene(B, 1, 3), [], 6),
    "kleene conditions": (Kleene(B, 2, 3), [rising, one_k], 25),
    "kleene values": (Kleene(B, 1, 2), [large, second], 20),
    "kleene over and": (Kleene(And(A, B), 1, 2), [lt("a", "b"), pairs_rise], 7),
    "kleene over seq": (Kleene(Seq(A, B), 2, 2), [eq("a", "b")], 6),
    "seq with kleene": (Seq(A, Kleene(B, 1, 2), C), [cross], 10),
    "and with kleene": (And(A, Kleene(B, 2, 2)), [cross], 8),
}


@pytest.mark.parametrize("name", CASES)
def test_matches_equal_brute_force(spark, name):
    structure, conds, window = CASES[name]
    p = Pattern(structure, AndCondition(*[c for c, _ in conds]), timedelta(seconds=window))
    for seed in (1, 2):
        events = stream(seed)
        want = keys(evaluate(structure if not isinstance(structure, Kleene) else Seq(structure), events, window * S, [f for _, f in conds]))
        positive = bound_names(Seq(*[a for a in getattr(structure, "args", (structure,)) if not isinstance(a, Not)]))
        if name == "nested not":
            positive -= {"d"}
        got = row_keys(Engine(p).run(frame(spark, events)).collect(), positive)
        assert got == want, (name, seed)


@pytest.mark.parametrize("planner", ["ascending_frequency", "greedy", "iterative_improvement", "dynamic_left_deep", "dynamic_bushy", "zstream", "zstream_ordered"])
def test_join_orders_do_not_change_matches(spark, planner):
    p = Pattern(Seq(A, B, Not(D), C, A2), AndCondition(EqCondition(Var("a", "k"), Var("c", "k"))), timedelta(seconds=9))
    events = frame(spark, stream(5))
    want = row_keys(Engine(p).run(events).collect(), {"a", "b", "c", "a2"})
    got = Engine(p, planner=planner, rates={"A": 5.0, "B": 3.0, "C": 0.5, "D": 1.0}).run(events).collect()
    assert row_keys(got, {"a", "b", "c", "a2"}) == want and want


def test_buckets_do_not_change_matches(spark):
    p = Pattern(And(A, B, C), AndCondition(EqCondition(Var("a", "k"), Var("b", "k"))), timedelta(seconds=4))
    events = frame(spark, stream(6))
    want = row_keys(Engine(p).run(events).collect(), {"a", "b", "c"})
    assert row_keys(Engine(p, Options(bucket_keyed=False)).run(events).collect(), {"a", "b", "c"}) == want and want


def test_window_is_inclusive_and_order_not_strict(spark):
    events = [{"seq": 0, "event_type": "B", "us": 0, "k": 0, "x": 0}, {"seq": 1, "event_type": "A", "us": 0, "k": 0, "x": 0}, {"seq": 2, "event_type": "B", "us": 5 * S, "k": 0, "x": 0}]
    rows = Engine(Pattern(Seq(A, B), window=timedelta(seconds=5))).run(frame(spark, events)).collect()
    assert sorted((r.a__seq, r.b__seq) for r in rows) == [(1, 0), (1, 2)]


def test_contiguous(spark):
    events = stream(7)
    p = Pattern(Seq(A, B, C), window=timedelta(seconds=40), policy=Policy(contiguous=["a", "b"]))
    rows = Engine(p).run(frame(spark, events)).collect()
    assert all(r.b__seq == r.a__seq + 1 for r in rows)
    lists = Pattern(Seq(A, B, C), window=timedelta(seconds=40), policy=Policy(contiguous=[["a", "b"], ["b", "c"]]))
    strict = Engine(lists).run(frame(spark, events)).collect()
    assert all(r.b__seq == r.a__seq + 1 and r.c__seq == r.b__seq + 1 for r in strict)
    assert len(Engine(lists, Options(compat=True)).run(frame(spark, events)).collect()) == len(rows)


def greedy(rows, names, types):
    out, used = [], set()
    for r in sorted(rows, key=lambda r: (max(r[n] for n in names), *[r[n] for n in names])):
        own = {r[n] for n in names if n[0] in types}
        if not own & used:
            used |= own
            out.append(r)
    return out


@pytest.mark.parametrize("small", [100_000, 0])
def test_single(spark, monkeypatch, small):
    monkeypatch.setattr("eventweave.operators.policies.SMALL", small)
    events = frame(spark, stream(8))
    base = {"window": timedelta(seconds=10)}
    rows = [{n: r[f"{n}__seq"] for n in "abc"} for r in Engine(Pattern(Seq(A, B, C), **base)).run(events).collect()]
    for types, policy in (("a", Policy(single="A")), ("ab", Policy(single=["A", "B"])), ("abc", Policy(primary="single"))):
        got = Engine(Pattern(Seq(A, B, C), policy=policy, **base)).run(events).collect()
        want = greedy(rows, "abc", types)
        assert sorted((r.a__seq, r.b__seq, r.c__seq) for r in got) == sorted((r["a"], r["b"], r["c"]) for r in want), types


def test_next_takes_the_first_partial_match(spark):
    events = [{"seq": i, "event_type": t, "us": i * S, "k": 0, "x": 0} for i, t in enumerate("ABBCC")]
    p = Pattern(Seq(A, B, C), window=timedelta(seconds=10), policy=Policy(single="A", secondary="next"))
    rows = Engine(p).run(frame(spark, events)).collect()
    assert [(r.a__seq, r.b__seq, r.c__seq) for r in rows] == [(0, 1, 3)]


def test_freeze(spark):
    # While the first A has no match, the second one is ignored; after its match at 2 the A at 3 starts anew.
    events = [{"seq": i, "event_type": t, "us": i * S, "k": 0, "x": 0} for i, t in enumerate("AABAB")]
    p = Pattern(Seq(A, B), window=timedelta(seconds=10), policy=Policy(freeze="a"))
    rows = Engine(p).run(frame(spark, events)).collect()
    assert sorted((r.a__seq, r.b__seq) for r in rows) == [(0, 2), (0, 4), (3, 4)]


def plain_freeze(matches, events, types, frozen, window):
    """The matches that freezing leaves, by going through the stream. frozen: freezer -> the names that it stops."""
    active, ignored, out = [], set(), []
    for e in events:
        active = [f for f in active if e["us"] - f[1]["us"] <= window]
        stopped = {n for f, _ in active for n in frozen[f]}
        for n, t in types.items():
            if t == e["event_type"] and n in stopped:
                ignored.add((n, e["seq"]))
            elif t == e["event_type"] and n in frozen:
                active.append((n, e))
        for m in sorted((m for m in matches if max(m.values()) == e["seq"]), key=repr):
            if not ignored & set(m.items()):
                out.append(m)
                active = [(n, x) for n, x in active if m[n] != x["seq"]]
    return out


@pytest.mark.parametrize(
    "structure, freeze, frozen",
    [
        (Seq(A, B), "a", {"a": "a"}),
        (Seq(A, B, C), "b", {"b": "ab"}),
        (Seq(A, B, C), ["a", "c"], {"a": "a", "c": "abc"}),
        (And(Seq(A, B), Seq(C, D)), ["a", "d"], {"a": "a", "d": "cd"}),
        (Seq(A, Event("A", "e"), B), "a", {"a": "a"}),
    ],
)
def test_freeze_is_as_going_through_the_stream(spark, structure, freeze, frozen):
    kept = 0
    for seed in range(3):
        events, same_k = stream(seed + 20, n=36, span=60, types=sorted(e.type for e in events_of(structure))), EqCondition(Var("a", "k"), Var("b", "k"))
        rows = Engine(Pattern(structure, AndCondition(same_k), timedelta(seconds=9))).run(frame(spark, events)).collect()
        types = {e.name: e.type for e in events_of(structure)}
        matches = [{n: r[f"{n}__seq"] for n in types} for r in rows]
        got = Engine(Pattern(structure, AndCondition(same_k), timedelta(seconds=9), Policy(freeze=freeze))).run(frame(spark, events)).collect()
        want = plain_freeze(matches, events, types, frozen, 9 * S)
        assert sorted(tuple(r[f"{n}__seq"] for n in types) for r in got) == sorted(tuple(m.values()) for m in want)
        kept += 0 < len(want) < len(matches)
    assert kept


def test_freezing_sends_only_what_can_change_it_through_one_partition(spark, monkeypatch):
    # Two of type A and 200 of type B, all of which match: 402 matches and other events would have to be sorted by one task.
    events = [{"seq": i, "event_type": t, "us": i * S, "k": 0, "x": 0} for i, t in enumerate("ABA" + "B" * 200)]
    events, passed = frame(spark, events), []
    own = type(events).mapInPandas
    monkeypatch.setattr(type(events), "mapInPandas", lambda df, *a, **k: passed.append(df.count()) or own(df, *a, **k))
    rows = Engine(Pattern(Seq(A, B), window=timedelta(hours=1), policy=Policy(freeze="a"))).run(events).collect()
    assert len(rows) == 401 and passed == [4]


def test_probability(spark):
    rows = [(0, "A", 0, 0.9), (1, "C", S, 0.5), (2, "B", 2 * S, 0.8), (3, "A", 3 * S, 0.2), (4, "B", 4 * S, None)]
    events = spark.createDataFrame(rows, "seq long, event_type string, us long, prob double")
    window = timedelta(seconds=10)
    got = Engine(Pattern(Seq(A, B), window=window, confidence=0.5)).run(events).collect()
    assert sorted((r.a__seq, r.b__seq, round(r.match_prob, 9)) for r in got) == [(0, 2, 0.72), (0, 4, 0.9)]
    got = Engine(Pattern(Seq(A, Not(C), B), window=window, confidence=0.3)).run(events).collect()
    assert sorted((r.a__seq, r.b__seq, round(r.match_prob, 9)) for r in got) == [(0, 2, 0.36), (0, 4, 0.45)]
    with pytest.raises(ValueError):
        Engine(Pattern(Seq(A, B), window=window)).run(events)


def test_several_patterns_share_and_keep_their_ids(spark):
    events = frame(spark, stream(9))
    patterns = [
        Pattern(Seq(A, B), AndCondition(EqCondition(Var("a", "k"), Var("b", "k"))), timedelta(seconds=9)),
        Pattern(Seq(A, B), AndCondition(EqCondition(Var("b", "k"), Var("a", "k"))), timedelta(seconds=4)),
        Pattern(Seq(C, Not(D), A), window=timedelta(seconds=5)),
    ]
    for share in (True, False):
        rows = Engine(patterns, share=share).run(events).collect()
        for i, p in enumerate(patterns, 1):
            names = {"a", "b"} if i < 3 else {"c", "a"}
            assert row_keys([r for r in rows if r.pattern_id == i], names) == row_keys(Engine(p).run(events).collect(), names)


@pytest.mark.parametrize("share", ["subtrees", "tabu", "annealing"])
def test_shared_parts_are_made_once_and_change_no_match(spark, monkeypatch, share):
    events = frame(spark, stream(11))
    same_k, seconds = EqCondition(Var("a", "k"), Var("b", "k")), lambda n: timedelta(seconds=n)
    patterns = [
        Pattern(Seq(A, B, C), AndCondition(same_k), seconds(9)),
        Pattern(Seq(A, Not(D), B, A2), AndCondition(same_k, EqCondition(Var("b", "k"), Var("a2", "k"))), seconds(5)),
        Pattern(Seq(D, And(Seq(A, B), C)), AndCondition(same_k), seconds(7)),
        Pattern(Seq(C, D), window=seconds(4)),
        Pattern(Seq(A, C, B), AndCondition(same_k), seconds(6)),
        Pattern(Seq(A, B, C), AndCondition(same_k), seconds(6), Policy(single="A")),
    ]
    names = [{"a", "b", "c"}, {"a", "b", "a2"}, {"a", "b", "c", "d"}, {"c", "d"}, {"a", "b", "c"}, {"a", "b", "c"}]
    made = []
    monkeypatch.setattr("eventweave.engine.cut", lambda df: made.append(df) or cut(df))
    rates = {"A": 5.0, "B": 3.0, "C": 0.5, "D": 1.0}
    for more in ({}, {"planner": "dynamic_bushy", "rates": rates}):
        made.clear()
        rows = Engine(patterns, share=share, **more).run(events).collect()
        assert 1 <= len(made) <= 2
        for i, (p, n) in enumerate(zip(patterns, names, strict=True), 1):
            want = row_keys(Engine(p).run(events).collect(), n)
            assert row_keys([r for r in rows if r.pattern_id == i], n) == want and (want or i == 3), i


def test_errors(spark):
    events = frame(spark, stream(1))
    with pytest.raises(ValueError):
        Pattern(Seq(A, Event("B", "a")))
    with pytest.raises(ValueError):
        Pattern(Seq(A, B), AndCondition(EqCondition(Var("a", "k"), Var("z", "k"))))
    with pytest.raises(ValueError):
        Engine(Pattern(Seq(A, Not(C), Not(D)), AndCondition(EqCondition(Var("c", "k"), Var("d", "k"))), timedelta(seconds=3))).run(events)
    with pytest.raises(ValueError):
        Engine(Pattern(And(Not(A), Not(B)), window=timedelta(seconds=3))).run(events)
    with pytest.raises(ValueError):
        KCIndexCondition("b", "x", EQ, first_index=0)
    with pytest.raises(Exception, match="largest size"):
        Engine(Pattern(Kleene(B), window=timedelta(seconds=40)), Options(kleene_limit=3)).run(events).collect()


def test_empty_stream_and_nulls(spark):
    empty = frame(spark, [])
    assert Engine(Pattern(Seq(A, Not(C), B), window=timedelta(seconds=3))).run(empty).count() == 0
    rows = [(0, "A", 0, None), (1, "B", 1, 3), (2, None, 2, 3)]
    df = spark.createDataFrame(rows, "seq long, event_type string, us long, k long")
    assert Engine(Pattern(Seq(A, B), AndCondition(EqCondition(Var("a", "k"), Var("b", "k"))), timedelta(seconds=3))).run(df).count() == 0


def test_python_logic_runs_as_a_vectorised_function(spark):
    events = stream(3)
    op = SimpleCondition(Var("a", "x"), Var("b", "x"), relation_op=lambda x, y: 1 < x < y and int(y) % 2 == 0)
    rows = Engine(Pattern(Seq(A, B), AndCondition(op), timedelta(seconds=20))).run(frame(spark, events)).collect()
    want = evaluate(Seq(A, B), events, 20 * S, [({"a", "b"}, lambda m: 1 < m["a"]["x"] < m["b"]["x"] and m["b"]["x"] % 2 == 0)])
    assert row_keys(rows, {"a", "b"}) == keys(want)


def test_standard_events_reads_timestamps_without_zone(spark):
    df = spark.sql("select 7 id, 'A' event_type, timestamp_ntz'1969-12-31 23:59:59' ts")
    assert standard_events(df, seq="id").first().us == -S
