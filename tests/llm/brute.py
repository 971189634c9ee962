"""Plain restatements of the operators' results for small tables."""
from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(UPPER) if lower else text)


def shingle_set(text: str | None, k: int = 5) -> set:
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def jaccard_components(rows: list[tuple[int, str | None]]) -> set[tuple[int, int, int]]:
    """Rows (doc_id, n_shingles, component_id)."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders: dict = {}
    for i, s in enumerate(sets):
        near = {}
        for g in s:
            for j in holders.get(g, ()):
                near[j] = near.get(j, 0) + 1
            holders.setdefault(g, []).append(i)
        for j, both in near.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    first: dict = {}
    for i, (d, _) in enumerate(rows):
        first[top(i)] = min(d, first.get(top(i), d))
    return sorted((d, len(sets[i]), first[top(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def repeated_lines(rows: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
    """(doc_id, line) of every line with an earlier match."""
    lines = [(d, i, shingle_set(x)) for d, t in rows for i, x in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    holders, out, done = {}, set(), []
    for d, i, s in lines:
        near: dict = {}
        for g in s:
            for j in holders.get(g, ()):
                near[j] = near.get(j, 0) + 1
        if any(100 * both >= 80 * (len(s) + len(done[j]) - both) for j, both in near.items()):
            out.add((d, i))
        for g in s:
            holders.setdefault(g, []).append(len(done))
        done.append(s)
    return out


def repeats_removed(rows: list[tuple[int, str | None]], k: int = 20) -> list[tuple]:
    """Rows (doc_id, n_words, n_removed, kept_sha256) for distinct ids."""
    import hashlib
    first: dict = {}
    texts = {d: words(t) for d, t in rows}
    for d in sorted(texts):
        w = texts[d]
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i:i + k]), (d, i))
    out = []
    for d, w in texts.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] != (d, i):
                gone[i:i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)
