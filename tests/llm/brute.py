"""Plain re-statements of what the operators return, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations
from math import log10

import pandas as pd

SPACED, LETTERED = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(doc_id, modulus: int):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def frame(df) -> pd.DataFrame:
    return df.toPandas().sort_values("doc_id", ignore_index=True)


def shingle_set(text: str | None) -> frozenset:
    w = re.findall(SPACED, lowered(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def least_reachable(nodes, links) -> dict:
    own = {n: n for n in nodes}

    def top(n):
        while own[n] != n:
            n = own[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        own[b] = a
    return {n: top(n) for n in nodes}


def near_duplicates(texts: dict) -> dict:
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = least_reachable(sets, links)
    return {i: (len(sets[i]), least[i]) for i in sets}


def contamination(text: str | None, items: dict) -> tuple:
    """(n_words, n_hit, item ids) of one text."""
    words, hit, found = re.findall(LETTERED, lowered(text)), set(), set()
    for item, item_text in items.items():
        w = re.findall(LETTERED, lowered(item_text))
        size = min(len(w), 13)
        windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1 if windows else 0):
            if tuple(words[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def language_model(texts: list, held: list, order: int, mu: float) -> list:
    """(n_tokens, n_known, base_score, score) of every text."""
    docs = [re.findall(SPACED, lowered(t)) + ["</s>"] for t in texts]
    counts, totals = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]

    def history(w, i, n):
        h = w[max(0, i - n + 1):i]
        return tuple(h if len(h) == n - 1 else ["<s>", *h])

    for w, out in zip(docs, held):
        for i in range(len(w) if not out else 0):
            for n in range(1, order + 1):
                h = history(w, i, n) if n > 1 else ()
                counts[n][h, w[i]] += 1
                totals[n][h] += 1
    n_all, types = totals[1][()], len(counts[1])

    def p(n, w, i):
        if n == 1:
            return (counts[1][(), w[i]] + 1) / (n_all + types + 1)
        h = history(w, i, n)
        return (counts[n][h, w[i]] + mu * p(n - 1, w, i)) / (totals[n][h] + mu)

    return [(len(w), sum(counts[1][(), x] > 0 for x in w), sum(log10(p(1, w, i)) for i in range(len(w))),
             sum(log10(p(order, w, i)) for i in range(len(w)))) for w in docs]
