"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at white space between words, where none of the tokenizer's
steps looks across (see ``safe`` below), so the count of a text is the sum
over its pieces. Pieces not met before are encoded in batches of about equal
bytes; their lengths are kept in a table of bounded size, because most pieces
come again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import widened, worker_store

#: Bytes of one call of the tokenizer.
BATCH_BYTES = 1 << 18
#: Characters of a text split at once.
SLICE_CHARS = 1 << 20
#: Pieces whose lengths are remembered in a task.
MEMORY_PIECES = 400_000


def batches_by_bytes(pieces, limit: int = BATCH_BYTES):
    """``pieces`` in lists of about ``limit`` bytes (a longer piece alone)."""
    out, size = [], 0
    for p in pieces:
        n = 4 * len(p)
        if out and size + n > limit:
            yield out
            out, size = [], 0
        out.append(p)
        size += n
    if out:
        yield out


def pieces(text: str):
    """The pieces of a text in lists, slice by slice. Cuts are runs of ASCII
    white space only: the tokenizer's normaliser (canonical composition, white
    space to a blank, lower case by character) and its word pattern never join
    across one, and its special strings hold none."""
    a = 0
    while a < len(text):
        b = min(len(text), a + SLICE_CHARS)
        if b < len(text):
            cut = max(text.rfind(c, a, b) for c in " \n\t\r")
            while cut < 0 and b < len(text):  # one piece longer than a slice
                c = min(len(text), b + SLICE_CHARS)
                found = [x for x in (text.find(c2, b, c) for c2 in " \n\t\r") if x >= 0]
                cut, b = (min(found), min(found)) if found else (-1, c)
            b = cut if cut > a else b
        yield text[a:b].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        a = b + 1 if b < len(text) and text[b] in " \n\t\r" else b


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` as the ``tokenizers``
    file at ``tokenizer_path`` (readable on every executor) gives them without
    added special tokens, and ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty: 0 bytes, 0 tokens. The tokenizer must drop
    white space between words. Columns of these three names are replaced."""
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = docs.drop(*new)
    names = kept.columns
    at = names.index(text_col)
    schema = widened(kept.schema, n_bytes="long", n_tokens="long", over_limit="boolean")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        held = worker_store().setdefault("tokenizers", {})  # for the worker's next tasks too
        if tokenizer_path not in held:
            held[tokenizer_path] = Tokenizer.from_file(tokenizer_path), {"": 0}
        tokenizer, known = held[tokenizer_path]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(at):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode("utf-8")))
                total = 0
                for part in pieces(text):
                    fresh = {p for p in part if p not in known}
                    if len(known) + len(fresh) > MEMORY_PIECES:
                        known.clear()
                        known[""] = 0
                        fresh = set(part) - {""}
                    for some in batches_by_bytes(fresh):
                        for piece, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                            known[piece] = len(e)
                    total += sum(map(known.__getitem__, part))
                n_tokens.append(total)
            count = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_bytes, pa.int64()), count,
                                              pa.array([n > limit for n in n_tokens], pa.bool_())], [*names, *new])

    return kept.mapInArrow(run, schema)
