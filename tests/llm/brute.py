"""Plain Python statements of what the operators must give, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LAST = (1 << 63) - 1
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def digest(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def place(insight_id):
    return LAST if insight_id is None else insight_id


def repeated_passages(rows, size=50):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - size + 1):
            first[raw[k:k + size]] = min(first.get(raw[k:k + size], 1 << 70), place(i))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if first[raw[k:k + size]] < place(i):
                gone[k:k + size] = b"\1" * size
        spans = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, digest(bytes(b for b, g in zip(raw, gone, strict=True) if not g))))
    return out


def near_duplicates(rows, percent):
    sets = []
    for _, text in rows:
        w = TOKEN.findall(lower(text))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for k, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in having[x] if j > k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[find(k)] = min(smallest.get(find(k), 1 << 70), place(i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = smallest[find(k)]
        out.append((i, len(sets[k]), None if c == LAST else c, place(i) == c))
    return out


def held_out_hits(rows, items, size=10):
    windows = {}
    for item_id, text in items:
        w = WORD.findall(lower(text))
        for x in ([tuple(w[k:k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []):
            windows.setdefault(x, set()).update([] if item_id is None else [str(item_id)])
    out = []
    for i, text in rows:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for length in {len(x) for x in windows}:
            for k in range(len(w) - length + 1):
                ids = windows.get(tuple(w[k:k + length]))
                if ids is not None:
                    hit.update(range(k, k + length))
                    found |= ids
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


def text_counts(text):
    text = text or ""
    w = TOKEN.findall(text)
    grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    repeat = {j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if TOKEN.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(repeat)


def base_places(text, phrases):
    w = WORD.findall(lower(text))
    found = [(k, label) for phrase, label in phrases for k in range(len(w) - len(phrase.split()) + 1) if w[k:k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))
