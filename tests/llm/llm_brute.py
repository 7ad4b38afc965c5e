"""Plain single-process versions of what the operators return, written from their contracts."""

import hashlib
import re
from collections import defaultdict


def groups(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def jaccard(docs):
    """docs: (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets = {}
    for d, t in docs:
        sets[d] = shingles(t)
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = defaultdict(int)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    edges = [(a, b) for (a, b), k in common.items() if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k)]
    comp = groups(sets, edges)
    return sorted((d, len(sets[d]), comp[d]) for d, _ in docs)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def pii(text):
    s = base_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    return tuple(sum(k == x for k, _, _ in s) for x in BASE) + (hashlib.sha256(joined.encode()).hexdigest(),)


def targets(sizes, total=1.5, cap=2.0, weights=(3.0, 1.0, 2.0)):
    """sizes: source -> size; the shares by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, left = {}, set(), total * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            full.add(s)
            left -= target[s]


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        last = row
    return last[-1]


def contamination(text, items, share=0.2):
    """item -> smallest distance of the windows that match."""
    w = re.findall(r"\w+", (text or "").lower())
    out = {}
    for item, t in items:
        v = re.findall(r"\w+", (t or "").lower())
        n, k = len(v), int(share * len(v) + 1e-9)
        if not n or not w:
            continue
        wins = [w[i : i + n] for i in range(len(w) - n + 1)] or ([w] if len(w) >= n - k else [])
        best = min((edit_distance(v, x) for x in wins), default=k + 1)
        if best <= k:
            out[item] = best
    return out
