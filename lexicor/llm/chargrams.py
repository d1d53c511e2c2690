"""Flat code-point arrays of text columns and n-gram buckets over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Characters handled at once; a longer text is worked through in slices.
SLICE_CHARS = 1 << 18
_P = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def char_table(keep) -> np.ndarray:
    """Booleans over the basic multilingual plane; the last entry stands for
    all characters above it."""
    t = np.zeros(0x10000, bool)
    t[[i for i in range(0x10000) if not 0xD800 <= i < 0xE000 and keep(chr(i))]] = True
    t[0xFFFF] = True
    return t


def slices(col: pa.Array, limit: int = SLICE_CHARS, overlap: int = 8):
    """Groups of text parts with at most about ``limit`` characters:
    ``(row numbers, parts)``. A longer text comes in several parts, cut at a
    white-space character where there is one."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(col):
        text = text.as_py() or ""
        a = 0
        while True:
            b = len(text)
            if b - a > limit:
                b = a + limit
                gap = max(text.rfind(" ", a, b), text.rfind("\n", a, b))
                b = gap if gap > a else b
            if size and size + b - a > limit:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(text[a:b])
            size += b - a
            a = b
            if a >= len(text):
                break
    if rows:
        yield rows, parts


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all parts, each behind a line feed and one at the end,
    and where each part's line feed is (``len(parts) + 1`` places)."""
    flat = np.frombuffer(("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    return flat, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def gram_buckets(codes: np.ndarray, inner: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each character, or -1 where its
    inner characters are not all of a word (``inner``: boolean per character;
    the first and last character may be the word's edge)."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(size, n * 0x51ED27, np.uint64)
        for k in range(n):
            h = h * _P + codes[k:k + size]
        bucket = ((h * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)
    ok = inner[1:1 + size].copy() if n > 2 else inner[:size] | inner[n - 1:n - 1 + size]
    for k in range(2, n - 1):
        ok &= inner[k:k + size]
    bucket[~ok] = -1
    return bucket
