"""Top-n similarity against numpy brute force."""
import numpy as np
from pyspark.sql import functions as F

from lexicor.operators import similarity as sim


def test_most_similar_matches_numpy_and_excludes_inputs(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 16))
    vocab = spark.createDataFrame([(f"w{i}", vecs[i].tolist()) for i in range(300)], "word string, vector array<double>")
    queries = spark.createDataFrame([(i, vecs[i].tolist(), [f"w{i}"], 7) for i in range(0, 300, 7)],
                                    "query_id int, qvec array<double>, exclude array<string>, topn int")
    out = sim.most_similar(vocab, queries, vocab_block_rows=40, query_block_rows=9)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.word, r.similarity))
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for q in range(0, 300, 7):
        s = unit @ unit[q]
        order = [j for j in np.lexsort((np.array([f"w{j}" for j in range(300)]), -s)) if j != q][:7]
        rows = sorted(got[q])
        assert [w for _, w, _ in rows] == [f"w{j}" for j in order]
        assert all(abs(x - s[j]) < 1e-9 for (_, _, x), j in zip(rows, order))
        assert [x for _, _, x in rows] == sorted([x for _, _, x in rows], reverse=True)


def test_signed_query_and_unknown_terms(spark):
    vocab = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [-1.0, 0.2])],
                                  "word string, vector array<double>")
    terms = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", True), (2, "zz", False)],
                                  "query_id int, term string, positive boolean")
    ranked, unknown = sim.signed_most_similar(vocab, terms, 1)
    assert [(r.query_id, r.word) for r in ranked.collect()] == [(1, "c")]
    assert [(r.query_id, r.term) for r in unknown.collect()] == [(2, "zz")]


def test_query_table_labels_and_display(spark):
    vocab = spark.createDataFrame([("soy_-_based_food", [1.0, 0.1]), ("plant", [0.9, 0.2]), ("beef", [0.0, 1.0]),
                                   ("animal", [-0.1, 1.0]), ("tofu", [1.0, 0.0])], "word string, vector array<double>")
    q = spark.createDataFrame([(1, "Plant", 2, [("beef", False)])],
                              "query_id int, term string, topn int, vectors array<struct<term:string,positive:boolean>>")
    answers, unknown = sim.answer_query_table(vocab, q)
    rows = answers.orderBy("rank").collect()
    assert rows[0].query == "Plant - beef" and rows[0].term in ("soy-based food", "tofu")
    assert unknown.count() == 0


def test_topn_kernel_holds_the_vectors_once_and_few_scores():
    import tracemalloc

    import numpy as np
    import pandas as pd
    from lexicor.operators import similarity as sim
    rng = np.random.default_rng(1)
    n, dims = 40_000, 64
    vocab = pd.DataFrame({"word": np.arange(n), "vector": list(rng.standard_normal((n, dims)).astype(np.float32))})
    queries = pd.DataFrame({"query_id": np.arange(300), "qvec": list(vocab["vector"][:300]), "exclude": [[i] for i in range(300)], "topn": 3})
    queries.at[299, "qvec"] = np.full(dims, np.nan)
    tracemalloc.start()
    got = sim._topn_kernel()(vocab, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    v = np.vstack(vocab["vector"]).astype(float)
    cos = v @ v[7] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[7])
    cos[7] = -1
    assert got[got.query_id == 7]["word"].tolist() == np.argsort(-cos)[:3].tolist()
    assert got[got.query_id == 299]["similarity"].tolist() == [0, 0, 0]


def test_unit_binds_the_norm_once(spark):
    import time

    from lexicor.functions import vectors as vx
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    got = [r.u for r in rows.select(vx.unit(F.col("v")).alias("u")).collect()]
    assert got == [[0.6, 0.8], None, None, None]
    # One pass over the components, not one for every component.
    long = spark.range(8, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda x: x.cast("float")).alias("v"))
    start = time.time()
    assert long.select(F.sum(F.get(vx.unit(F.col("v")), 0))).first()[0] > 0
    assert time.time() - start < 8
