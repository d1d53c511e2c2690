"""Words and their hashes do not depend on how a batch is cut."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexicor.llm.arrowtext import ALNUM_SEP, WHITE_SEP, by_bytes, shingle_hashes, spans, text_buffer, word_hashes


@pytest.mark.parametrize("limit", [3, 17, 1 << 20])
def test_word_hashes_by_any_cut(limit):
    rng = random.Random(limit)
    texts = ["".join(rng.choice("aB é\n.ß9") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "x" * 100, "  ", "É é"]
    data, offsets = text_buffer(pa.array(texts)[0:])
    for sep, pattern in ((WHITE_SEP, r"[^\x20\x09-\x0D]+"), (ALNUM_SEP, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        hashes, first = word_hashes(data, offsets, sep, limit)
        words = [re.findall(pattern, (t or "").replace("B", "b")) for t in texts]
        assert [len(w) for w in words] == np.diff(first).tolist()
        flat = [w for ws in words for w in ws]
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    ends = [b for _, b in spans(data, offsets, WHITE_SEP, limit)]
    assert not len(data) or ends[-1] == len(data)


def test_sliced_and_wide_columns():
    col = pa.array(["skip", "a b", None, "c"], pa.large_string()).slice(1)
    data, offsets = text_buffer(col)
    assert bytes(data) == b"a bc" and offsets.tolist() == [0, 3, 3, 4]
    assert len(shingle_hashes(np.zeros(2, np.uint64), 3)) == 0


def test_batches_by_bytes_keep_every_row():
    texts = ["a" * 10, None, "", "b" * 50, "c", "d" * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["i", "text"])
    parts = list(by_bytes([batch.slice(1), batch, batch.slice(0, 0)], 1, limit=12))
    assert [r["text"] for p in parts for r in p.to_pylist()] == texts[1:] + texts
    assert all(p.num_rows <= 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= 12 for p in parts)
    assert parts[-1].num_rows == 0
