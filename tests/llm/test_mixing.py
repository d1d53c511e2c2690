"""Source mixing against a plain version."""
import hashlib
import math
import random
import re

import pytest

from lexicor.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_mix(rows, weights=(3, 1, 2), share=1.5, epochs=2, seed=13):
    """Expected (id, size, source size, target, taken) of every row."""
    total = {}
    for _, text, source in rows:
        total[source] = total.get(source, 0) + words(text)
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    want, free, target = share * sum(total.values()), set(names), {}
    while free:
        level = (want - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if epochs * total[s] <= level * weight[s]]
        for s in over:
            target[s] = float(epochs * total[s])
            free.discard(s)
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
    out = []
    for s in names:
        size = total[s]
        copies = min(epochs, math.floor(target[s] / size)) if size else 0
        rest = math.floor(target[s] - copies * size + 0.5)
        own = sorted((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), words(t), i)
                     for i, t, source in rows if source == s)
        for _, n, i in own:
            part = max(0, min(n, rest))
            rest -= part
            out.append((i, n, size, round(target[s], 6), copies * n + part))
    return sorted(out, key=str)


def rows_of(seed, n_sources, hot):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(n_sources)] + ["é", "Z", "", None]
    rows = []
    for i in range(400):
        source = names[0] if rng.random() < hot else rng.choice(names)
        rows.append((i, " ".join("w" for _ in range(int(rng.paretovariate(0.8)) % 5000)), source))
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, key string")
    got = mixing.mix(docs, **options)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "part", "taken"]
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed,n_sources,hot", [(1, 3, 0.4), (2, 30, 0.5), (3, 0, 0.0)])
def test_mix_equals_the_plain_version(spark, seed, n_sources, hot):
    rows = rows_of(seed, n_sources, hot)
    got = run(spark, rows)
    assert got == plain_mix(rows)
    assert abs(sum(r[4] for r in got) - 1.5 * sum(r[1] for r in got)) <= n_sources + 4
    assert all(r[4] <= 2 * r[1] for r in got)


def test_other_shares_and_seeds(spark):
    rows = rows_of(5, 6, 0.3)
    assert run(spark, rows, share=0.2, seed=4) == plain_mix(rows, share=0.2, seed=4)
    assert run(spark, rows, share=9.0, epochs=3) == plain_mix(rows, share=9.0, epochs=3)
    assert run(spark, rows, share=2.5, epochs=4, weight=mixing.by_place((1, 10))) == plain_mix(
        rows, share=2.5, epochs=4, weights=(1, 10))


def test_long_ranges_are_sorted_only_where_the_target_ends(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DIGITS", 1)
    rows = rows_of(6, 2, 0.6)
    assert run(spark, rows) == plain_mix(rows)


def test_mix_of_odd_rows(spark):
    long = "w " * 300_000
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "x y z", "a"), (None, "x y z", None),
            (4, long, "b"), (5, " \t\n", "c"), (6, "   x", "d")]
    assert run(spark, rows) == plain_mix(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.mix(docs.where("text is null or trim(text) = ''")).collect()
    assert [(r["taken"], r["target"]) for r in nothing] == [(0, 0.0)] * 2 or all(r["taken"] == 0 for r in nothing)
