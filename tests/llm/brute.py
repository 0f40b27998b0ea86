"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def linked(sets, percent: int):
    """All pairs of the (id, set) whose sets are so alike, by counting what each shares with all before it."""
    holders: dict = {}
    for n, (i, a) in enumerate(sets):
        common = Counter(k for x in a for k in holders.get(x, ()))
        for k, c in common.items():
            if 100 * c >= percent * (len(a) + len(sets[k][1]) - c):
                yield i, sets[k][0]
        for x in a:
            holders.setdefault(x, []).append(n)


def near_groups(rows, size: int, percent: int) -> dict[int, int]:
    """doc_id to the smallest doc_id reachable, over all pairs; texts None or without words are alone."""
    sets = shingle_sets(rows, size)
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in linked(sets, percent):
        x, y = sorted((root(i), root(j)))
        up[y] = x
    return {i: root(i) for i in up}


def shingle_sets(rows, size: int) -> list[tuple[int, set]]:
    sets = []
    for i, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(_LOWER)) if w]
        k = min(size, len(words))
        sets.append((i, {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()))
    return sets


def contaminated(docs, items, length: int = 10):
    """(doc_id, n_words, n_hit, sorted item ids) of each document."""
    words = lambda t: _WORD.findall((t or "").translate(_LOWER))
    windows: dict[tuple, set] = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + length]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def near_items(docs, items, slop: int, length: int = 10) -> dict:
    """doc_id to the number of items with a window each word of which stands within slop of its place for some start."""
    words = lambda t: _WORD.findall((t or "").translate(_LOWER))
    out = {}
    for d, text in docs:
        at: dict[str, set] = {}
        doc = words(text)
        for k, x in enumerate(doc):
            at.setdefault(x, set()).add(k)
        found = set()
        for i, t in items:
            w = words(t)
            for k in range(max(1, len(w) - length + 1) if w else 0):
                window = w[k : k + length]
                if i is not None and any(all(any(p + o + e in at.get(x, ()) for e in range(-slop, slop + 1)) for o, x in enumerate(window)) for p in range(-slop, len(doc) + slop)):
                    found.add(i)
        out[d] = len(found)
    return out


def within_one(a, b) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[k + 1 :] == b[k:]


def kept_lines(rows, least: int, near: int) -> dict[int, str | None]:
    """doc_id to its text without repeated lines; rows in order of doc_id, ids distinct."""
    out, earlier, seen = {}, [], set()
    for i, text in rows:
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = tuple(x for x in re.split(r"[ \t\v\f\r]+", line) if x)
            again = len(w) >= least and (w in seen or len(w) >= near and any(within_one(w, x) for x in earlier if len(x) >= near))
            if len(w) >= least and w not in seen:
                seen.add(w)
                earlier.append(w)
            if not again:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out
