"""Whole-batch text primitives on numpy: word spans, word hashes, shingles.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  Hashes are
polynomials mod 2**64 taken from prefix sums, so a batch of texts is hashed
without a Python loop over words; they depend on the word's bytes only, never
on the batch, the process or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled by one numpy pass; bounds memory, not the text.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEP = np.ones(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n + 1:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Deal texts into passes of about CHUNK bytes; longer ones are cut between words."""
    parts, owner, held = [], [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        at = 0
        while at < len(raw):
            end = min(len(raw), at + CHUNK)
            while end < len(raw) and _SEP[raw[end]]:
                end += 1
            parts.append(raw[at:end])
            owner.append(i)
            held += end - at
            at = end
            if held >= CHUNK:
                yield parts, owner
                parts, owner, held = [], [], 0
    if parts:
        yield parts, owner


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the index of its text, in text order."""
    hashes, owners = [], []
    table = _LOWER if lower else np.arange(1, 257, dtype=np.uint64)
    for parts, owner in _pieces(texts):
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        word = _SEP[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        up, down = _power(len(data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * up[: len(data)], dtype=np.uint64)))
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts]))
        first = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
        owners.append(np.asarray(owner, np.int64)[np.searchsorted(first, starts, side="right") - 1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(words: np.ndarray, owner: np.ndarray, size: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words; a text of fewer words has one run, all its words."""
    counts = np.bincount(owner, minlength=n_texts)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    runs = np.zeros(len(words), np.uint64)
    place = np.arange(len(words)) - starts[owner]
    for k in range(size):
        inside = place + k < counts[owner]
        runs = mix(runs * np.uint64(31) + np.where(inside, padded[k : k + len(words)], np.uint64(k + 1)))
    keep = (place == 0) | (place + size <= counts[owner])
    return runs[keep], owner[keep]


def unique_per_text(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (text, value) with how often each occurs; of values the upper 48 bits count."""
    out = []
    for base in range(0, int(owner.max()) + 1 if len(owner) else 0, 1 << 16):
        lo, hi = np.searchsorted(owner, (base, base + (1 << 16)))
        packed = ((owner[lo:hi] - base).astype(np.uint64) << np.uint64(48)) | (values[lo:hi] >> np.uint64(16))
        packed.sort()
        first = np.ones(len(packed), bool)
        first[1:] = packed[1:] != packed[:-1]
        at = np.flatnonzero(first)
        kept = packed[at]
        out.append((kept << np.uint64(16), (kept >> np.uint64(48)).astype(np.int64) + base, np.diff(np.concatenate((at, [len(packed)])))))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def slices(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters together, one text at least."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
