"""Trigram index and tagged scan against plain scans."""
import random

import pytest

from lexicor.operators import store, trigrams


@pytest.mark.parametrize("block", [trigrams.BLOCK, 7])
def test_search_equals_a_scan(spark, tmp_path, block):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", "AB", "Fe2O3 oxide", "FE2O3", "x" * 5000 + "needle", "日本語テキスト"]
    rows = [(i % 100 if i % 9 else None, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int")
    words = ["abc", "ab", "a", "É a", "fe2o3", "needle", "xxxxxxx", "本語テ", "cab c", "zzz", "abca", "", None, "a", "A", "oxide", " "]
    index = trigrams.build(docs, str(tmp_path / "index"), block=block)
    got = trigrams.search(index, spark.createDataFrame([(w, 1) for w in words], "keyword string, id int"), block=block)
    want = [(w, i) for w in {w for w in words if w} for i, t, _ in rows if t is not None and w.lower() in t.lower()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["keyword", "id"]
    empty = trigrams.build(docs.limit(0), str(tmp_path / "none"))
    assert trigrams.search(empty, docs.selectExpr("text as keyword")).count() == 0


def test_trigram_lists_of_a_span_equal_plain_sets():
    import numpy as np
    import pyarrow as pa
    rng = random.Random(3)
    for case in range(60):
        texts = ["".join(rng.choice("ab\0é日𝄞 ") for _ in range(rng.choice([0, 1, 2, 3, 5, 40]))) for _ in range(rng.choice([0, 1, 5, 40]))]
        number = np.arange(len(texts)) + rng.randint(0, 100)
        got = {}
        for i, j in trigrams._spans(pa.array(texts, pa.string()), 50):
            for gram, k, found in zip(*(c.to_pylist() for c in trigrams._lists(number[i:j], texts[i:j], 7).columns)):
                got.setdefault((gram, k), []).extend(found)
        want = {}
        for n, t in zip(number.tolist(), texts):
            for gram in {t[x:x + 3] for x in range(len(t) - 2)}:
                want.setdefault((gram, n // 7), []).append(n)
        assert got == want, case


def test_lookup_reads_only_the_keyword(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of words") for i in range(50)], "doc_id long, text string")
    found = trigrams.lookup(trigrams.build(docs, str(tmp_path / "index")), "Words")
    assert {r["gram"] for r in found.collect()} == {"wor", "ord", "rds"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(gram" in plan
    assert len(found.first()["steps"]) == 50


def test_tagged_scan_prunes_and_equals_array_contains(spark, tmp_path):
    rng = random.Random(2)
    tags = [f"t{i}" for i in range(12)]
    rows = [(i, rng.sample(tags, rng.choice([0, 1, 1, 2, 4]))) for i in range(300)] + [(900, None), (901, [None, "t1"]), (902, ["t1"])]
    table = spark.createDataFrame(rows, "key long, tags array<string>")
    path = str(tmp_path / "tagged")
    store.write_tagged(table, path)
    for tag in (*tags, "other"):
        found = store.scan_tagged(spark, path, tag)
        assert found.columns == ["key", "tags"]
        assert sorted(r["key"] for r in found.collect()) == sorted(k for k, t in rows if t and tag in t)
    plan = store.scan_tagged(spark, path, "t1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(signature" in plan or "PartitionFilters: [NOT ((signature" in plan or "signature" in plan.split("PartitionFilters:")[1][:120]
    store.write_tagged(table.limit(0), str(tmp_path / "none"))
    assert store.scan_tagged(spark, str(tmp_path / "none"), "t1", table.schema).count() == 0
    read = store.scan_tagged(spark, path, "t1").inputFiles()
    assert 0 < len(read) <= len(spark.read.parquet(path).inputFiles())
