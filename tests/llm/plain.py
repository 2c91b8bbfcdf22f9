"""Plain versions of the operators, row by row, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hits(text, items, window=10):
    """Hit word places and item ids of one text."""
    ws, places, names = words(text), set(), set()
    for item, item_text in items:
        it = words(item_text)
        n = min(window, len(it))
        grams = {tuple(it[k : k + n]) for k in range(len(it) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1) if n else ():
            if tuple(ws[k : k + n]) in grams:
                places |= set(range(k, k + n))
                names.add(item)
    return ws, places, names


def shingles(text, width):
    ws = blank_words(text)
    if not ws:
        return frozenset()
    width = min(width, len(ws))
    return frozenset(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1))


def linked_components(rows, width):
    """doc_id -> smallest doc_id reachable, over all pairs."""
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(shingles(text, width))
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets, key=lambda d: (d is not None, d))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda d: (d is not None, d))
                root[y] = x
    return {doc: find(doc) for doc in ids}


def clean_lines(rows, min_sites=5, min_chars=10, max_share=0.5):
    """(boilerplate lines, removed lines, clean text) of each (source, text)."""
    sites = {}
    for source, text in rows:
        for line in (text or "").split("\n") if text is not None else ():
            if len(line.strip(" ")) >= min_chars:
                sites.setdefault(line.strip(" "), set()).add(source)
    out = []
    for _, text in rows:
        if text is None:
            out.append((0, 0, None))
            continue
        lines = text.split("\n")
        hit = [len(sites.get(x.strip(" "), ())) >= min_sites for x in lines]
        copied = sum(len(x) for x, h in zip(lines, hit, strict=True) if h) > max_share * sum(map(len, lines))
        kept = text if copied or not any(hit) else "\n".join(x for x, h in zip(lines, hit, strict=True) if not h)
        out.append((sum(hit), 0 if copied else sum(hit), kept))
    return out


def blank_words_as_they_are(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
