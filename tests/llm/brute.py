"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text: str | None, k: int = 4) -> frozenset:
    ws = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(ws[i: i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])


def join_components(rows: list[tuple], percent: int = 85) -> list[tuple]:
    """(doc_id, set size, component) of (doc_id, text) rows, every pair of rows compared that shares a shingle."""
    sets = [shingle_set(t) if i is not None else frozenset() for i, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            holders[t].append(i)
    for pairs in {(h[0], j) for h in holders.values() for j in h[1:] if sets[h[0]] == sets[j]} | {(a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1:]}:
        a, b = pairs
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(shingle_set(t)), None if d is None else least[find(i)]) for i, (d, t) in enumerate(rows)]


def edit_distance_in(pattern: str, text: str) -> int:
    """Least edit distance of pattern to any part of text, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            above, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, above + (p != c))
        best = min(best, row[-1])
    return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    def digits(s: str) -> str:
        return re.sub("[^0-9]", "", s)

    def luhn(d: str) -> bool:
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]


def auc(labels: list[int], scores: list[float]) -> float:
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    good = sum(labels)
    ranks = sum(r for r, i in enumerate(order) if labels[i])
    return (ranks - good * (good - 1) / 2) / (good * (len(labels) - good))
