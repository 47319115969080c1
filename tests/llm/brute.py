"""The same results in plain Python, pair by pair and window by window."""

import itertools
import re

UPPER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def shingles(text, k=5):
    w = blank_words(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(texts):
    """Texts by place: the least place each is connected with."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def deleted_lines(texts, least_chars):
    """For texts in order, places of lines in any run of enough characters that is there earlier."""
    lines = [t.split("\n") for t in texts]
    seen, gone = set(), []
    for doc in lines:
        cut = set()
        runs = {}
        for i in range(len(doc)):
            for j in range(i + 1, len(doc) + 1):
                if sum(map(len, doc[i:j])) >= least_chars:
                    runs[i, j] = tuple(doc[i:j])
        for (i, j), run in sorted(runs.items()):
            if run in seen:
                cut |= set(range(i, j))
            seen.add(run)
        gone.append(cut)
    return lines, gone


def contaminated(text, items, size=10):
    """Words hit, and ids of items with a window in the text."""
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(size, len(v))
        for window in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) == window:
                    hit |= set(range(at, at + n))
                    ids.add(str(item_id))
    return len(w), len(hit), sorted(ids)
