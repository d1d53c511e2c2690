"""Arrow text columns as flat byte arrays, and word hashes over them.

Operators that read whole texts in ``mapInArrow`` work on one flat UTF-8 byte
array per Arrow batch. ``text_buffer`` exposes it without a copy, ``spans``
cuts a batch into contiguous byte ranges of bounded size (a cut is a row
boundary or a separator byte, so words stay whole and one very long text is
worked through in several ranges), and ``word_hashes`` turns it into 64-bit
word hashes with numpy only.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: Bytes handled at once by the numpy kernels: a range costs about 60 times
#: that in temporary arrays.
SPAN_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _splitmix(i: int) -> int:
    z = (i * _MULT + 0x1234567) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


def byte_values() -> np.ndarray:
    """One random 64-bit value per byte; A-Z share those of a-z."""
    v = np.array([_splitmix(b + 1) for b in range(256)], dtype=np.uint64)
    v[65:91] = v[97:123]
    return v


def separators(is_word) -> np.ndarray:
    """256 booleans: True where a byte separates words."""
    return np.array([not is_word(b) for b in range(256)])


#: Words of runs without ASCII white space.
WHITE_SEP = separators(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of ASCII letters, digits and every byte above ASCII.
ALNUM_SEP = separators(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string array; a null text is an empty one."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return flat, offsets - offsets[0]


def by_bytes(batches, column: int, limit: int = 4 * SPAN_BYTES):
    """The rows of Arrow batches in batches of about ``limit`` bytes of text of
    the column (a longer text is one of its own), and empty batches as they are."""
    for batch in batches:
        ends = text_buffer(batch.column(column))[1]
        a = 0
        while a < batch.num_rows or not batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            if not batch.num_rows:
                break
            a = b


def spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, limit: int = SPAN_BYTES):
    """Contiguous byte ranges ``(a, b)`` that cover ``data``; each ends at a
    row boundary, behind a separator, or (one longer word) at the next of them."""
    n, a = len(data), 0
    while a < n:
        b = min(a + limit, n)
        if b < n:
            row = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            if row > a:
                b = row
            else:
                hit = np.flatnonzero(sep[data[a:b]])
                if len(hit):
                    b = a + int(hit[-1]) + 1
                else:
                    end = int(offsets[np.searchsorted(offsets, b, "left")])
                    step = b
                    while step < end:
                        hit = np.flatnonzero(sep[data[step:step + limit]])
                        if len(hit):
                            step += int(hit[0]) + 1
                            break
                        step += limit
                    b = min(step, end)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray,
                limit: int = SPAN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words before each row
    (``n_rows + 1`` entries): the words of row i are
    ``hashes[first[i]:first[i + 1]]``. A-Z count as a-z."""
    values = byte_values()
    values[sep] = 0
    mult = np.uint64(0xD6E8FEB86659FD93)
    power = np.ones(64, np.uint64)
    hashes, starts_at = [], []
    for a, b in spans(data, offsets, sep, limit):
        part = data[a:b]
        word = ~sep[part]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        cut = offsets[np.searchsorted(offsets, a, "left"):np.searchsorted(offsets, b, "left")] - a
        begin[cut] = word[cut]
        starts = np.flatnonzero(begin)
        if not len(starts):
            continue
        place = np.arange(len(part), dtype=np.int64)
        place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(part))))
        place[:starts[0]] = 0
        place[~word] = 0
        longest = int(place.max()) + 1
        if longest > len(power):
            power = np.ones(2 * longest, np.uint64)
        if power[1] != mult:
            with np.errstate(over="ignore"):
                power[1:] = mult
                power = np.multiply.accumulate(power)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(values[part] * power[place], starts)
            hashes.append(mix(h + np.uint64(_MULT)))
        starts_at.append(starts + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.concatenate(starts_at)
    return np.concatenate(hashes), np.searchsorted(at, offsets, "left")


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (``len - k + 1`` of them,
    rows not yet told apart)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = mix(h + words[j:j + n] + np.uint64((j + 1) * 0x632BE59BD9B4E019 & _MASK))
    return h


def widened(schema: T.StructType, **fields) -> T.StructType:
    """A schema with further columns (name = type or its simple name)."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields.items():
        out.add(name, kind)
    return out


def worker_store() -> dict:
    """A dict that lives as long as the Python process: functions shipped by
    value have no module of their own that outlives a task."""
    name = "_lexicor_worker_store"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.store = {}
        sys.modules[name] = module
    return sys.modules[name].store
