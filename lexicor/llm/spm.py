"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into

* the normaliser: a blank before the text, blanks to the word mark, everything
  else as it is (models with other normalisation rules are refused);
* the piece arcs: one for every piece, its weight the negated score, its
  output the piece's id; found from any state by walking a prefix set;
* the fallback arcs: a character that is no piece goes out as its UTF-8 bytes;
* for merge models the joint: two arcs may follow each other only if merging
  their joined text gives just these two pieces again. Merging never crosses
  the borders of its own result, so a path whose neighbours all pass is that
  result, and the only path of finite weight.

An input is composed with all of it on the fly and the tropical-semiring
shortest path is taken. Where no piece arc can cross (before a word mark that
follows something else and, if no piece mixes them, between letters and other
characters) the input is cut first; the paths of such parts are remembered, because words come again.
"""

from __future__ import annotations

import re
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import widened, worker_store

#: The word mark of SentencePiece.
MARK = "▁"
#: What a worker remembers: the paths of so many parts (and as many before),
#: the states of so many beginnings, twice as many pairs of arcs. 100,000 take
#: about 60 MB of each Python worker; more save time on many rare words.
REMEMBER = 100_000
#: Parts and beginnings of more characters are worked out each time, so that
#: what is remembered is bounded in bytes too.
KEPT_CHARS = 64
#: States are kept at every so many characters.
STEP = 4
#: Characters cut into parts at once; output batches close at as many.
SLICE_CHARS = 1 << 20


def _fields(data: bytes):
    """``(number, value)`` of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


class _Paths(dict):
    """Packed ids of the parts met last; the generation before is behind it."""

    def __init__(self, machine, older):
        self.machine, self.older = machine, older

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = np.array(self.machine.path(part.replace(" ", MARK)), np.int32).tobytes()
        if len(part) <= KEPT_CHARS:
            self[part] = ids
        return ids


class Transducer:
    """The compiled model (see the module text)."""

    def __init__(self, model_path: str, remember: int = REMEMBER):
        import sentencepiece

        self.remember = remember
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = dict(_fields(model.serialized_model_proto()))
        trainer, normaliser = dict(_fields(proto[2])), dict(_fields(proto[3]))
        self.merges = trainer.get(3, 1) == 2
        self.prefix = bool(normaliser.get(3, 1))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only models with identity normalisation and escaped, kept white space are supported")
        n = model.get_piece_size()
        self.weight: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.out: list[bytes] = [b""] * n
        self.byte = [model.unk_id()] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.out[i] = bytes([value])
            elif model.is_unknown(i):
                self.out[i] = b" \xe2\x81\x87 "  # the library's surface of the unknown piece
            elif not model.is_control(i):
                self.weight[piece] = -model.get_score(i)
                self.id[piece] = i
                self.out[i] = piece.replace(MARK, " ").encode()
        self.starts = {p[:k] for p in self.weight for k in range(1, len(p) + 1)}
        # What a piece may end with, and whether that is a piece itself.
        self.kind = {p[k:]: p[k:] in self.weight for p in self.weight for k in range(len(p))}
        if max(map(len, self.weight)) > 255:
            raise ValueError("pieces of more than 255 characters are not supported")
        self.costly = 1e3 + max(self.weight.values())
        joined = {p[k:k + 2] for p in self.weight for k in range(len(p) - 1)}
        crossing = any(b == MARK != a for a, b in joined)
        letter = re.compile(r"[^\W\d_]").match
        mixed = any(a != MARK != b and bool(letter(a)) != bool(letter(b)) for a, b in joined)
        mark = f"[ {MARK}]"  # blanks become marks only where a path is looked for
        other = f"(?:[^\\w {MARK}]|[\\d_])+"
        self.part = None if crossing else re.compile(
            f"{mark}+[^ {MARK}]*|[^ {MARK}]+" if mixed else
            f"{mark}*[^\\W\\d_]+|{mark}*{other}|{mark}+").findall
        self.joint: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.memory = _Paths(self, {})
        self.heads: dict[str, bytes] = {}

    def _merge(self, text: str) -> list[str]:
        """The merge result: the best-scored adjacent pair first, then the
        leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = inf, -1
            for i in range(len(parts) - 1):
                w = self.weight.get(parts[i] + parts[i + 1], inf)
                if w < best:
                    best, at = w, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, a: str, b: str) -> bool:
        """Whether the arc of b may follow that of a (the start, if empty)."""
        if self.pairs >= 2 * self.remember:
            self.joint.clear()
            self.pairs = 0
        self.pairs += 1
        ok = self._merge(a + b) == ([a, b] if a else [b])
        self.joint.setdefault(a, {})[b] = ok
        return ok

    def path(self, text: str) -> list[int]:
        """Ids along the shortest path of one normalised part."""
        last = self._last_joined(text) if self.merges else self._last_cheapest(text)
        out: list[int] = []
        j = len(text)
        while j:
            arc = text[j - last[j]:j]
            i = self.id.get(arc)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in reversed(arc.encode("utf-8", "replace"))]
            j -= len(arc)
        out.reverse()
        return out

    def _last_cheapest(self, text: str) -> bytearray:
        """The length of the last arc of the cheapest path to every state."""
        n = len(text)
        cost = [inf] * (n + 1)
        last = bytearray(n + 1)
        cost[0] = 0.0
        for i in range(n):
            for j in range(i + 1, n + 1):
                arc = text[i:j]
                w = self.weight.get(arc, self.costly if j == i + 1 else None)
                if w is not None and cost[i] + w < cost[j]:
                    cost[j], last[j] = cost[i] + w, j - i
                if arc not in self.starts:
                    break
        return last

    def _last_joined(self, text: str) -> bytearray:
        """The same where arcs must be jointed: each state then has one arc of
        finite cost, so the first that passes is the cheapest. States depend
        on what is before them only, so the states of short beginnings are
        kept; from the longest one known on, the rest is filled in order."""
        n = len(text)
        last, known = bytearray(1), 0
        for k in range(min((n - 1) // STEP * STEP, KEPT_CHARS), 0, -STEP):
            held = self.heads.get(text[:k])
            if held is not None:
                last, known = bytearray(held), k
                break
        kind, joint = self.kind.get, self.joint
        for j in range(known + 1, n + 1):
            i = j - 1
            if known < i <= KEPT_CHARS and i % STEP == 0:
                if len(self.heads) >= self.remember:
                    self.heads.clear()
                self.heads[text[:i]] = bytes(last)
            arc = text[i]
            is_piece = True  # or a character that goes out as bytes
            while True:
                if is_piece:
                    before = text[i - last[i]:i]
                    row = joint.get(before)
                    ok = row.get(arc) if row is not None else None
                    if ok or ok is None and self._follows(before, arc):
                        last.append(j - i)
                        break
                i -= 1
                arc = text[i:j] if i >= 0 else ""
                is_piece = kind(arc)
                if is_piece is None:
                    raise ValueError("no path")
        return last

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none for an empty one."""
        out: list[bytes] = []
        a, first = 0, self.prefix
        while a < len(text):
            b = min(len(text), a + SLICE_CHARS)
            if b < len(text) and self.part is not None:
                cut = text.rfind(" ", a + 1, b)  # never inside a run of blanks
                while cut > a and text[cut - 1] in f" {MARK}":
                    cut -= 1
                b = cut if cut > a else len(text)
            elif b < len(text):
                b = len(text)
            part = text[a:b]
            if first:
                part, first = " " + part, False
            if self.part is None:
                out.append(np.array(self.path(part.replace(" ", MARK)), np.int32).tobytes())
            else:
                out.extend(map(self.memory.__getitem__, self.part(part)))
                if len(self.memory) >= self.remember:
                    self.memory = _Paths(self, dict(self.memory))
            a = b
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        """Text of ids: the surfaces in a row, without the blank of the
        prefix; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def _machine(model_path: str, remember: int = REMEMBER) -> Transducer:
    """The transducer of this Python worker for a model: what it remembers
    serves the worker's next tasks too."""
    held = worker_store().setdefault("transducers", {})
    if (model_path, remember) not in held:
        held[model_path, remember] = Transducer(model_path, remember)
    return held[model_path, remember]


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None, remember: int = REMEMBER) -> DataFrame:
    """``docs`` with the ids of every whole text, equal to those of the
    SentencePiece library for the model at ``model_path`` (readable on every
    executor), without begin or end ids; with ``decoded_col`` also whether
    decoding them gives the text back.

    Null and empty texts have no ids (and come back, a null as empty). A
    column named like a new one is replaced; all others are kept."""
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    kept = docs.drop(*new)
    names = kept.columns
    at = names.index(text_col)
    schema = widened(kept.schema, **{ids_col: T.ArrayType(T.IntegerType())})
    if decoded_col:
        schema = widened(schema, **{decoded_col: "boolean"})

    def run(batches):
        machine = _machine(model_path, remember)

        def close(batch, a, b, flat, sizes, same):
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
            more = [pa.array(same, pa.bool_())] if decoded_col else []
            return pa.RecordBatch.from_arrays(
                [*(c.slice(a, b - a) for c in batch.columns), pa.ListArray.from_arrays(pa.array(ends), values), *more],
                [*names, *new])

        for batch in batches:
            flat, sizes, same, size, begin = [], [], [], 0, 0
            for i, text in enumerate(batch.column(at)):
                text = text.as_py() or ""
                ids = machine.encode(text)
                flat.append(ids)
                sizes.append(len(ids))
                if decoded_col:
                    same.append(machine.decode(ids) == text)
                size += len(text)
                if size >= SLICE_CHARS:
                    yield close(batch, begin, i + 1, flat, sizes, same)
                    flat, sizes, same, size, begin = [], [], [], 0, i + 1
            if begin < batch.num_rows:
                yield close(batch, begin, batch.num_rows, flat, sizes, same)

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids (null ids: null)."""
    kept = encoded.drop(text_col)
    names = kept.columns
    at = names.index(ids_col)

    def run(batches):
        machine = _machine(model_path)
        for batch in batches:
            texts = [None if ids is None else machine.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text_col])

    return kept.mapInArrow(run, widened(kept.schema, **{text_col: "string"}))
