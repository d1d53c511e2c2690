"""Ranked lexical search against brute force."""
import math
import random
import re
from collections import Counter

import pytest

from lexicor.llm import lexical

FOLD = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms(text):
    return re.findall(lexical.TERM_PATTERN, (text or "").translate(FOLD))


def brute(docs, items, k=20):
    """Expected (item, rank, id, score)."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for name, text in items:
        wanted.setdefault(name, Counter()).update(terms(text))
    out = []
    for name, want in wanted.items():
        best = []
        for i, b in bags:
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * b[t] // (1000 * b[t] + 12 * (75 + 25 * b.total() * n_docs // total))) for t, c in want.items() if b[t])
            if score > 0:
                best.append((-score, i is None, i or 0))
        out += [(name, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(best)[:k])]
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcdéZ9") + rng.choice("xyzÀ") + str(rng.randrange(9)) for _ in range(120)]

    def text(n):
        return rng.choice([" ", ", ", "_", "\n"]).join(rng.choice(words[:rng.choice([5, 40, 120])]) for _ in range(n))

    docs = [(i, text(rng.randint(0, 60))) for i in range(250)]
    copies = [(1000 + i, docs[i % 7][1]) for i in range(120)]
    shuffled = [(2000 + i, " ".join(rng.sample(terms(docs[3][1]), len(terms(docs[3][1]))))) for i in range(30)]
    docs += copies + shuffled + [(5, docs[5][1]), (5, docs[6][1]), (None, docs[0][1]), (None, docs[3][1]), (7000, None), (7001, ""), (7002, "-- !"),
                                 (7003, (words[0] + " ") * 50_000 + words[1]), (7004, "q" * 9_000_000 + " " + words[2])]
    rng.shuffle(docs)
    items = [(i, text(rng.randint(1, 30))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "?"), (33, "unheard-of"), (3, items[3][1]), (4, "ax1 ax1 AX1"), (None, items[2][1])]
    return docs, items


@pytest.mark.parametrize("seed,item_bytes,cells", [(1, 1 << 25, 1 << 21), (2, 300, 64), (3, 1 << 25, 700)])
def test_search_equals_brute_force(spark, monkeypatch, seed, item_bytes, cells):
    monkeypatch.setattr(lexical.score_classes, "__defaults__", (cells, 20))
    docs, items = tables(seed)
    got = lexical.search(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, terms string"),
                         spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int"), item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_fewer_and_string_items(spark):
    docs, items = tables(4)
    items = [(f"i{i}", t) for i, t in items]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id string, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 12 * 100)))]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 2"), items), (docs, items.select("item_id").selectExpr("*", "string(null) as text"))):
        got = lexical.search(d, i)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_one_class_for_equal_bags(spark):
    rows = [(i, 75, [1, 4], [2, 1]) for i in range(50)] + [(90, 76, [1, 4], [2, 1]), (None, 75, [1, 4], [2, 1]), (91, 75, [1, 4], [1, 2])]
    got = lexical.classes_of(spark.createDataFrame(rows, "id long, m long, terms array<int>, tfs array<long>"), 20).collect()
    assert sorted((r["m"], r["tfs"], r["ids"]) for r in got) == [(75, [1, 2], [91]), (75, [2, 1], list(range(20))), (76, [2, 1], [90])]
