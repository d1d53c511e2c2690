"""Similarity joins and containment against brute force."""
import itertools
import random
import re

import numpy as np
import pytest

from lexicor.llm import jaccard
from lexicor.llm.decontam import find_contamination
from lexicor.llm.graphs import components
from lexicor.llm.jaccard import jaccard_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, threshold=90, n=3):
    """Expected (id, size, component) of every row with an id."""
    sets = [grams(t, n) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        inter, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and 100 * inter >= threshold * union:
            x, y = sorted((find(rows[a][0]), find(rows[b][0])))
            parent[y] = x
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets))


def family(rng, words, n, changes):
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = rng.choice(words)
        yield " ".join(w)


def fixture(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(3000)]
    texts = [*family(rng, words, 40, 4), *family(rng, words, 15, 12), *family(rng, words, 6, 1)]
    texts += ["one", "one", "One two", "one\ttwo", "", " \n", None, "a b c", "A B C", "a b c a b c"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(words) for _ in range(40)) for _ in range(20)]
    texts += [" ".join(words[:20]), " ".join(words[:21]), " ".join(words[:12]), " ".join(words[:11])]
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("max_rows", [1024, 5])
def test_components_equal_brute_force(spark, max_rows):
    rows = fixture(max_rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component_id int, node string")
    got = jaccard_components(docs, max_rows=max_rows)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_rows_of_a_large_group_meet_once(spark, monkeypatch):
    """Rows that share many blocks without being linked meet under their pivot,
    not block by block, and those that parity bits rule out not at all."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    texts = [" ".join(base[:150] + [rng.choice(words) for _ in range(50)]) for _ in range(60)]
    texts += [" ".join(base[:195] + [rng.choice(words) for _ in range(5)]) for _ in range(30)]
    made, cut = {}, jaccard.cut_lineage
    monkeypatch.setattr(jaccard, "cut_lineage", lambda df, name: made.setdefault(name, []).append(out := cut(df, name)) or out)
    rows = list(enumerate(texts))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), max_rows=8)
    assert sorted(map(tuple, got.collect())) == brute_components(rows)
    shared = made["blocks"][0].count()
    after = {k: sum(t.count() for t in v) for k, v in made.items()}
    after["blocks"] -= shared
    late = after["blocks"] + after.get("units", 0)
    assert late == 0 or late <= shared // 2, (late, shared)
    assert after.get("apart", 0) <= 2 * len(rows)


def test_components_at_a_lower_threshold(spark):
    rows = fixture(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs, threshold=80).collect())) == brute_components(rows, 80)


def test_components_of_five_words(spark):
    rows = fixture(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs, n_words=5, threshold=80).collect())) == brute_components(rows, 80, 5)


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(5)
    classes = {t: jaccard.size_classes(t, 1000) for t in (80, 90, 100, 50)}
    for _ in range(3000):
        base = rng.integers(0, 1 << 62, rng.integers(1, 200)).astype(np.uint64)
        threshold = int(rng.choice([80, 90, 100, 50]))
        other = base.copy()
        change = rng.random(len(base)) < rng.choice([0.02, 0.1, 0.2])
        other[change] = rng.integers(0, 1 << 62, change.sum())
        other = other[rng.random(len(other)) > rng.choice([0, 0.1])]
        x, y = np.unique(base), np.unique(other)
        both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if len(y) and 100 * both >= threshold * union:
            lo = classes[threshold]
            assert len(np.intersect1d(jaccard.block_rows(x, lo, threshold), jaccard.block_rows(y, lo, threshold)))
            assert jaccard.may_link(np.array([len(x), len(y)]), [jaccard.parity(x), jaccard.parity(y)], threshold).all()


def test_components_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (5, text), (9, text), (2, None), (2, ""), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 48, None), (5, 48, 5), (5, 48, 5), (9, 48, 5), (2, 0, 2), (2, 0, 2), (4, 1, 4)], key=str)
    assert jaccard_components(docs.limit(0)).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_contamination(docs, items, size=10):
    out = []
    for i, text in docs:
        w, hit, names = words_of(text), set(), set()
        for name, t in items:
            b = words_of(t)
            n = min(size, len(b))
            if name is None or not n:
                continue
            for k in range(len(b) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == b[k:k + n]:
                        hit.update(range(p, p + n))
                        names.add(str(name))
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_contamination_equals_brute_force(spark, block_words):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyz0"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([12, 25, 10, 9, 3, 2, 1, 30, 11])]
    items += [(20, items[1][1]), (20, "bx by, bz"), (None, items[0][1]), (21, None), (22, " ... ")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(25)]
    for _, t in items[:9]:
        w = t.split()
        texts.append("Start " + t.upper().replace(" ", ", ") + " end")
        texts.append(" ".join(w[1:]) + " | " + " ".join(w[:11]))
        texts.append(" ".join(rng.choice(words) for _ in range(15)) + " " + t + " " + t)
    docs = [(i % 30 if i % 11 else None, t) for i, t in enumerate([*texts, None, "", "..."])]
    got = find_contamination(spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, items string"),
                             spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_contamination(docs, items)


def test_contamination_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r) for r in find_contamination(docs, items.limit(0)).collect()] == [(1, 3, 0, [])]
    assert find_contamination(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("block_words", [2_000_000, 4])
def test_items_without_an_id_count_unnamed(spark, block_words):
    items = spark.createDataFrame([(None, "a b c d"), (7, "x y z"), (None, "x y z"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "q a b c d q"), (2, "x y z a b c d"), (3, "a b c"), (None, "a b c d")], "doc_id long, text string")
    got = sorted((tuple(r) for r in find_contamination(docs, items, block_words=block_words).collect()), key=str)
    assert got == [(1, 6, 4, []), (2, 7, 7, ["7"]), (3, 3, 0, []), (None, 4, 4, [])]


def test_components_of_edge_tables(spark):
    """Chains, stars, loops, repeated edges and no edges at all, held to union-find."""
    rng = random.Random(4)
    for edges in ([], [(1, 1)], [(2, 1), (1, 2)], [(i, i + 1) for i in range(120)], [(7, i) for i in range(30)] * 2,
                  [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]):
        up = {}
        for a, b in edges:
            if a != b:
                a, b = (_top(up, x) for x in (a, b))
                up[max(a, b)] = min(a, b)
        got = components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == sorted((x, _top(up, x)) for x in up)


def _top(up, x):
    up.setdefault(x, x)
    while up[x] != x:
        x = up[x]
    return x
