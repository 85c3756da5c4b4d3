"""Small pure-Python definitions used as brute-force references in tests."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict, deque


def pagerank(vertices, edges, reset=0.15, iters=10, source=None):
    out = Counter(s for s, _ in edges)
    r = {v: (1.0 if source is None else (1.0 if v == source else 0.0)) for v in vertices}
    for _ in range(iters):
        s = defaultdict(float)
        for a, b in edges:
            s[b] += r[a] / out[a]
        r = {v: ((reset if source is None else (reset if v == source else 0.0))
                 + (1 - reset) * s.get(v, 0.0)) for v in vertices}
    total = sum(r.values())
    scale = len(vertices) / total if source is None else 1.0 / total
    return {v: x * scale for v, x in r.items()}


def distances_to(vertices, edges, landmark):
    back = defaultdict(list)
    for a, b in edges:
        back[b].append(a)
    d = {landmark: 0}
    q = deque([landmark])
    while q:
        x = q.popleft()
        for y in back[x]:
            if y not in d:
                d[y] = d[x] + 1
                q.append(y)
    return d


def triangles(vertices, edges):
    und = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    nb = defaultdict(set)
    for a, b in und:
        nb[a].add(b)
        nb[b].add(a)
    cnt = Counter()
    for a, b, c in itertools.combinations(sorted(nb), 3):
        if b in nb[a] and c in nb[a] and c in nb[b]:
            cnt[a] += 1
            cnt[b] += 1
            cnt[c] += 1
    return {v: cnt.get(v, 0) for v in vertices}


def reach(vertices, edges, undirected=False):
    nb = defaultdict(set)
    for a, b in edges:
        nb[a].add(b)
        if undirected:
            nb[b].add(a)
    out = {}
    for v in vertices:
        seen = {v}
        q = deque([v])
        while q:
            x = q.popleft()
            for y in nb[x]:
                if y not in seen:
                    seen.add(y)
                    q.append(y)
        out[v] = seen
    return out


def components(vertices, edges):
    r = reach(vertices, edges, undirected=True)
    return {v: min(r[v]) for v in vertices}


def strong_components(vertices, edges):
    r = reach(vertices, edges)
    return {v: min(w for w in r[v] if v in r[w]) for v in vertices}


def label_propagation(vertices, edges, iters):
    lab = {v: v for v in vertices}
    for _ in range(iters):
        votes = defaultdict(Counter)
        for a, b in edges:
            votes[b][lab[a]] += 1
            votes[a][lab[b]] += 1
        new = {}
        for v in vertices:
            if votes[v]:
                best = max(votes[v].values())
                new[v] = min(l for l, c in votes[v].items() if c == best)
            else:
                new[v] = lab[v]
        lab = new
    return lab
