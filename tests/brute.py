"""A plain evaluator of patterns over a list of events, written from the semantics, for small streams."""

from itertools import combinations, product

from eventweave.plans.pattern import And, Event, Kleene, Not, Seq, names_of


class Match:
    def __init__(self, bound, first, last, arrival, used):
        self.bound, self.first, self.last, self.arrival, self.used = bound, first, last, arrival, used


def evaluate(node, stream, window, checks):
    """stream: list of dicts with seq, event_type, us. checks: list of (names, function of the bound dict)."""

    def holds(bound, before):
        names = set(bound)
        return all(f(bound) for need, f in checks if need <= names and not any(need <= set(b) for b in before))

    if isinstance(node, Event):
        out = [Match({node.name: e}, e["us"], e["us"], e["seq"], [e["seq"]]) for e in stream if e["event_type"] == node.type]
        return [m for m in out if holds(m.bound, [])]
    if isinstance(node, Kleene):
        names = names_of(node.arg)
        places = lambda m: [m.bound[n]["seq"] for n in names]
        inner = evaluate(node.arg, stream, window, [c for c in checks if node.list_name not in c[0]])
        inner.sort(key=lambda m: (m.arrival, places(m).index(m.arrival), places(m)))
        out = []
        for k in range(node.min_size, min(node.max_size or len(inner), len(inner)) + 1):
            for sub in combinations(inner, k):
                first, last = min(m.first for m in sub), max(m.last for m in sub)
                if last - first > window:
                    continue
                m = Match({node.list_name: [x.bound[n] for x in sub for n in names]}, first, last, max(x.arrival for x in sub), [s for x in sub for s in x.used])
                if holds(m.bound, []):
                    out.append(m)
        return out
    parts = [None if isinstance(a, Not) else evaluate(a, stream, window, checks) for a in node.args]
    out = []
    for combo in product(*[p for p in parts if p is not None]):
        places = [i for i, p in enumerate(parts) if p is not None]
        if isinstance(node, Seq) and any(a.last > b.first for a, b in zip(combo, combo[1:], strict=False)):
            continue
        first, last = min(m.first for m in combo), max(m.last for m in combo)
        used = [s for m in combo for s in set(m.used)]  # a closure may repeat an event
        if last - first > window or len(set(used)) < len(used):
            continue
        bound = {k: v for m in combo for k, v in m.bound.items()}
        if not holds(bound, [m.bound for m in combo]):
            continue
        arrival = max(m.arrival for m in combo)
        blocked = False
        for i, a in enumerate(node.args):
            if not isinstance(a, Not):
                continue
            for n in evaluate(a.arg, stream, window, checks):
                if set(n.used) & set(used) or max(last, n.last) - min(first, n.first) > window:
                    continue
                if isinstance(node, Seq):
                    before = [m for p, m in zip(places, combo, strict=True) if p < i]
                    after = [m for p, m in zip(places, combo, strict=True) if p > i]
                    if before and n.first < before[-1].last or after and (n.last > after[0].first or n.arrival >= arrival):
                        continue
                if holds({**bound, **n.bound}, [bound, n.bound]):
                    blocked = True
        if not blocked:
            out.append(Match(bound, first, last, arrival, used))
    return out


def keys(matches):
    """A comparable form: for each match, its names with the places of their events."""
    one = lambda v: tuple(e["seq"] for e in v) if isinstance(v, list) else v["seq"]
    return sorted((tuple(sorted((n, one(v)) for n, v in m.bound.items())) for m in matches), key=repr)


def row_keys(rows, names):
    out = []
    for r in rows:
        d = r.asDict()
        out.append(tuple(sorted((n, d[f"{n}__seq"] if f"{n}__us" in d else tuple(e["seq"] for e in d[n])) for n in names)))
    return sorted(out, key=repr)


__all__ = ["And", "evaluate", "keys", "row_keys"]
