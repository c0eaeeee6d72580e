"""Plain Python forms of what the operators return, row by row."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import pairwise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words)}


def license_base(text: str | None) -> dict:
    words = LICENSE_WORD.findall(ascii_lower(text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return {"n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({x for _, x in places}))}


def shingles(text: str | None) -> set:
    words = WORD.findall(ascii_lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (number of shingles, smallest id reachable)."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders: dict = {}
    for d, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(d)
    pairs = {(a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def edited(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, str]]:
    """doc_id -> (characters, SHA-256 of the edited text)."""
    rows = sorted((d, t or "") for d, t in rows)
    out = {}
    for (d, t), (_, after) in pairwise([*rows, rows[0]]):
        half = len(t) // 2
        out[d] = (len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest())
    return out


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def least_capacity(sizes: list[int], shards: int) -> int:
    def fits(capacity):
        used, now = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            used, now = (used, now + s) if now + s <= capacity else (used + 1, s)
        return used <= shards
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low
