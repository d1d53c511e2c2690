"""Classifiers: held-out accuracy, odd rows, and the pieces they are made of."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicor.llm import chargrams, langid, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def held(doc_id, parts, value):
    return zlib.crc32(str(doc_id).encode()) % parts == value


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_toxicity_on_held_out_rows(spark):
    got = queries.op1_toxicity(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(table(spark, "labels"), "doc_id", "left").collect()
    assert len(rows) == 10_000
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    known = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    toxic = [r["predicted"] for r in known if r["toxic"] == 1]
    clean = [r["predicted"] for r in known if r["toxic"] == 0]
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.03


def test_misspelt_words_share_subwords():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(300):
        bag = [rng.choice(words) for _ in range(40)]
        if i % 2:
            bag[rng.randrange(40)] = "zyxwvut"
        texts.append(" ".join(bag))
        labels.append(i % 2)
    model = toxicity.train(texts, np.array(labels))
    table = chargrams.char_table(str.isalnum)

    def z(text):
        found, _ = toxicity._features([text], table)
        bucket = np.concatenate([b for _, b in found])
        return model.bucket_logit[bucket].sum() / (toxicity.PADDING + len(bucket)) + model.bias

    plain = " ".join(words[:39])
    assert z(plain + " zyxwvuty") > z(plain + " abcabca") + 0.5
    assert z(plain + " zyxwvut") == z(plain + " zyxwvut zyxwvut")


def odd_docs(spark, score_type="string"):
    long = "plain words of a very long text " * 60_000
    own = str if score_type == "string" else ord
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "12 34 !?", None, "c"), (None, "some words here", "en", "d"),
            (4, long, "en", "e"), (4, long, "en", "e"), (5, "x", "", "f"), (6, "\U0001F600" * 5, None, "g")]
    return spark.createDataFrame([(*r[:3], own(r[3])) for r in rows], f"doc_id long, text string, lang string, score {score_type}")


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(None, 1), (4, 0), (2, None), (7, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    one = {str(r["doc_id"]): r["score"] for r in got}
    assert one["1"] == one["2"]
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_long_texts_score_as_in_one_piece(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(2000))
    col, word = pa.array([text, "short one", None]), chargrams.char_table(str.isalnum)

    def count():
        total = np.zeros(3)
        for rows, parts in chargrams.slices(col, limit):
            found, places = toxicity._features(parts, word)
            for place, bucket in found:
                sums = np.append(0, np.cumsum(bucket % 1009))
                np.add.at(total, rows, np.diff(sums[np.searchsorted(place, places)]))
        return total

    limit = 1 << 19
    whole = count()
    limit = 100
    # A repeat across a cut is the only thing that a slice cannot see.
    assert np.allclose(count(), whole, rtol=0.002)
    tables = quality._tables()
    assert quality.features(col, tables).shape == (3, quality.N_FEATURES)
    assert not quality.features(pa.array([None, ""]), tables).any()


def test_quality_on_held_out_rows(spark):
    got = queries.op5_quality_pu(spark, SF)
    rows = got.join(table(spark, "labels"), "doc_id", "left").collect()
    assert len(rows) == 10_000
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    known = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] for r in known if r["quality"] == 1]) > 0.99
    assert np.mean([r["predicted"] for r in known if r["quality"] == 0]) < 0.15


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_and_risk_on_a_known_mixture(share):
    rng = np.random.default_rng(int(10 * share))
    width = quality.N_FEATURES

    def draw(n, good):
        x = rng.normal(0, 1, (n, width))
        x[:, :3] += np.where(good, 2.0, -2.0)[:, None]
        return x

    good = rng.random(4000) < share
    mixed = draw(4000, good)
    model = quality.train(draw(2000, np.ones(2000, bool)), mixed)
    assert abs(model.prior - share) < 0.12
    score = quality._sigmoid((mixed - model.mean) / model.scale @ model.weights + model.bias)
    assert ((score >= 0.5) == good).mean() > 0.9


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark, "int")
    good = spark.createDataFrame([(4,), (None,), (99,)], "doc_id long")
    got = quality.score(docs, quality.fit(docs, good)).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    none = quality.fit(docs.limit(0), good.limit(0))
    assert none.prior == 0.5 and {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    got = queries.op9_language_zstd(spark, SF)
    rows = got.join(table(spark, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 10_000
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]) > 0.97
    assert np.mean([r["lang_accepted"] for r in rows]) > 0.98


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    train = spark.createDataFrame([(i, ("the quick brown fox " if i % 2 else "der schnelle braune fuchs ") * 5, "en" if i % 2 else "de")
                                   for i in range(20)] + [(30, None, "fr"), (31, "bonjour", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert sorted(model.dictionaries) == ["de", "en"]
    got = langid.classify(docs.withColumn("lang_pred", F.lit(3)), model).collect()
    und = {str(r["doc_id"]) for r in got if r["lang_pred"] == "und"}
    assert len(got) == 8 and und == {"1", "2", "3", "6"}
    assert all(not r["lang_accepted"] and r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in langid.classify(docs, langid.fit(train.limit(0))).collect()} == {"und"}
    assert langid.classify(docs.limit(0), model).count() == 0
