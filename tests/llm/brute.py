"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text: str | None) -> frozenset[tuple[str, ...]]:
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def roots(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """Set size and component of each document."""
    sets = {i: shingles(t) for i, t in rows}
    posts = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            posts[g].append(i)
    shared = Counter()
    for members in posts.values():
        shared.update(combinations(sorted(members), 2))
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}
