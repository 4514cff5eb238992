"""Plain-Python versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near(rows: list[tuple], width: int, percent: int = 80) -> dict:
    """(doc_id, set size) -> component, by comparing all that share a shingle."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(k)
    shared: Counter = Counter()
    for k, (_, s) in enumerate(sets):
        mine: Counter = Counter()
        for g in s:
            mine.update(j for j in holders[g] if j < k)
        shared.update({(j, k): n for j, n in mine.items()})
    for (j, k), n in shared.items():
        union = len(sets[j][1]) + len(sets[k][1]) - n
        if 100 * n >= percent * union:
            a, b = find(sets[j][0]), find(sets[k][0])
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets}


def encode(path: str, text: str | None) -> list[int]:
    tokenizer = _tokenizer(path)
    return tokenizer.encode(text or "", add_special_tokens=False).ids


_loaded: dict = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 10 or 100 * len(inside) > 20 * len(words),
    }


def sha(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
