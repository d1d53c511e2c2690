"""Classifier, embeddings, stream = batch, and the driver contract."""
import json
import os
import time

from pyspark.sql import functions as F

from conftest import SF


def test_tfidf_long_equals_ml_features(spark):
    from lexicor.operators import relevance as rel
    docs = spark.createDataFrame([(1, "Alpha beta beta gamma"), (2, "beta delta"), (3, "gamma gamma épée")],
                                 "doc_id long, text string")
    long = {(r.doc_id, r.term): r.weight for r in rel.tfidf_long(docs, docs).collect()}
    model = rel.fit_tfidf(docs)
    vocab = model.stages[1].vocabulary
    for r in model.transform(docs).collect():
        v = r.features
        got = {(r.doc_id, vocab[i]): x for i, x in zip(v.indices, v.values)}
        assert set(got) == {k for k in long if k[0] == r.doc_id}
        assert all(abs(got[k] - long[k]) < 1e-12 for k in got)
        assert abs(sum(x * x for x in v.values) - 1.0) < 1e-9


def test_classifier_separates_languages(spark):
    from lexicor.operators import relevance as rel
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text", (F.col("lang") == "en").cast("double").alias("label"))
    train = docs.where(rel.split_flag(F.col("doc_id")))
    test = docs.where(~rel.split_flag(F.col("doc_id")))
    pred = rel.predict(rel.fit_classifier(train), test)
    rep = {r["class"]: r for r in rel.classification_report(pred).collect()}
    assert rep["1"].recall > 0.9 and rep["0"].recall > 0.9
    assert rep["accuracy"].f1 > 0.9


def test_word2vec_neighbours_of_planted_pairs(spark):
    from lexicor.operators import embeddings as em
    import random
    rnd = random.Random(1)
    groups = [(["salt", "pepper"], [f"a{i}" for i in range(6)]), (["bread", "butter"], [f"b{i}" for i in range(6)])]
    sents = []
    for _ in range(4000):
        words, ctx = rnd.choice(groups)
        sents.append(rnd.sample(ctx, 2) + [rnd.choice(words)] + rnd.sample(ctx, 2))
    df = spark.createDataFrame([(s,) for s in sents], "toks array<string>")
    vec = em.word_vectors(em.train_word2vec(df, dims=16, epochs=5, partitions=2))
    assert vec.count() > 10
    answers, unknown = em.exploration_batch(vec, ["bread", "flavor"], "salt", "butter", [("salt", "pepper", "bread")],
                                            user_term="salt")
    user = [r.word for r in answers.where("variant = 'user'").orderBy("rank").collect()]
    assert "pepper" in user[:3]
    assert unknown.where("term = 'flavor'").count() >= 1


def _land(src, f, lines):
    src.mkdir(exist_ok=True)
    (src / f"part{f}.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    os.utime(src / f"part{f}.jsonl", (time.time() + f, time.time() + f))


def _articles(f):
    return [{"paper_id": f"p{i}", "doi": f"10.9/{i % 7}" if i % 2 else "", "title": f"t{f}-{i}",
             "abstract": "" if i == 5 else f"Sample {i} of file {f}. Iron oxide Fe2O3 at 5K."} for i in range(f * 4, f * 4 + 8)]


def _stored(df):
    return sorted((r.key_type, r.key, r.title, r.processed_abstract, tuple(r.tags))
                  for r in df.select("key_type", "key", "title", "processed_abstract", "tags").collect())


def test_stream_equals_batch(spark, tmp_path):
    from lexicor.plans.ingest import ingest, prepare
    from lexicor.sources import providers as pv
    from lexicor.streaming.ingest import stream_metrics, stream_s2orc

    src, root = tmp_path / "in", str(tmp_path / "store")
    for f in range(3):
        _land(src, f, _articles(f))

    def run():
        return stream_s2orc(spark, str(src), root, str(tmp_path / "ckpt"), general_tag="general")

    streamed = _stored(run())
    rows, _ = prepare(pv.s2orc_articles(pv.read_s2orc(spark, str(src))), "s2orc", None, "general", "s2orc")
    batch, _ = ingest(None, rows)
    assert streamed == _stored(batch)
    assert "iron oxide" in streamed[0][3].lower()
    # a second run over the same files is a no-op
    assert _stored(run()) == streamed
    m = {(r.epoch, r.kind, r.name): (r.total, r.relevant, r.already_tagged) for r in stream_metrics(spark, root).collect()}
    # p5 of the first two files has no abstract; keys of file 1: p4, p6, p8, p10 and four DOIs, some known
    assert m[(0, "reject", "no_abstract")][0] == 1 and m[(1, "reject", "no_abstract")][0] == 1
    assert m[(0, "tag", "general")] == (7, 7, 0)
    assert sum(v[1] for k, v in m.items() if k[1] == "tag") == len(streamed)


def test_second_source_and_new_checkpoint_lose_nothing(spark, tmp_path):
    from lexicor.streaming.ingest import stream_s2orc

    root = str(tmp_path / "store")
    for name, f in (("a", 0), ("b", 1), ("c", 2)):
        _land(tmp_path / name, 0, _articles(f))
        got = stream_s2orc(spark, str(tmp_path / name), root, str(tmp_path / f"ckpt-{name}"), general_tag="general")
    keys = {(x["doi"] or x["paper_id"]) for f in range(3) for x in _articles(f) if x["abstract"]}
    assert {r.key for r in got.collect()} == keys


def test_restart_and_replay_repeat_nothing(spark, tmp_path):
    from lexicor.streaming.ingest import stream_s2orc

    src, root, ckpt = tmp_path / "in", str(tmp_path / "store"), tmp_path / "ckpt"
    _land(src, 0, _articles(0))
    first = _stored(stream_s2orc(spark, str(src), root, str(ckpt), general_tag="general"))
    # the last batch is not yet committed when the driver stops: it runs again
    for name in (tmp_path / "ckpt" / "commits").iterdir():
        name.unlink()
    _land(src, 1, _articles(1))
    got = _stored(stream_s2orc(spark, str(src), root, str(ckpt), general_tag="general"))
    keys = {(x["doi"] or x["paper_id"]) for f in range(2) for x in _articles(f) if x["abstract"]}
    assert {r[1] for r in got} == keys and len(got) == len(keys)
    assert [r for r in got if r[1] in {x[1] for x in first}] == first
    changes = spark.read.parquet(f"{root}/changes").groupBy("key").count().where("count > 1").count()
    assert changes == 0


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    from lexicor.operators import rejects as rj
    from lexicor.operators import store as st

    def batch(rows):
        return rj.with_identity(spark.createDataFrame(
            [(k, None, None, None, t, tags, i) for i, (k, t, tags) in enumerate(rows)],
            "doi string, uid string, pmc string, paperid string, title string, tags array<string>, _seq long"))

    path = str(tmp_path / "s")
    assert st.read_buckets(spark, path) is None
    st.upsert_into(spark, path, batch([(f"10.1/{i}", f"t{i}", ["x"]) for i in range(60)]), ["title"], n_buckets=16)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").glob("bucket=*/*.parquet")}
    per_key = st.upsert_into(spark, path, batch([("10.1/3", "new title", ["y"]), ("10.1/new", "n", [])]), ["title"], n_buckets=16)
    assert sorted((r.key, r.is_new, r.added) for r in per_key.collect()) == [("10.1/3", False, ["y"]), ("10.1/new", True, [])]
    kept = [f for f in before if f.exists() and f.stat().st_mtime_ns == before[f]]
    assert len({f.parent for f in before} - {f.parent for f in kept}) <= 2 and kept
    got = {r.key: (r.title, r.tags) for r in st.read_buckets(spark, path).collect()}
    assert len(got) == 61 and got["10.1/3"] == ("t3", ["x", "y"]) and got["10.1/new"] == ("n", [])
    # the same batch again changes nothing
    again = st.upsert_into(spark, path, batch([("10.1/3", "new title", ["y"])]), ["title"], n_buckets=16)
    assert [(r.is_new, r.added) for r in again.collect()] == [(False, [])]
    assert {r.key: (r.title, r.tags) for r in st.read_buckets(spark, path).collect()} == got


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert df.columns == ["query_id", "rank", "neighbour_id", "similarity"]


def test_corpus_text_sink_round_trip(spark, tmp_path):
    from lexicor.functions.fixed_values import CORPUS_RECORD_SEP
    from lexicor.operators import corpus
    df = spark.createDataFrame([("a b\nc",), ("d e",), ("f",)], "cleaned string")
    corpus.write_corpus_text(df, str(tmp_path / "out"))
    back = spark.read.option("lineSep", CORPUS_RECORD_SEP).text(str(tmp_path / "out"))
    assert sorted(r.value for r in back.collect()) == ["a b\nc", "d e", "f"]


def test_model_and_phrase_table_round_trip(spark, tmp_path):
    from lexicor.operators import embeddings as em
    from lexicor.operators import phrases as ph
    from lexicor.operators import relevance as rel
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad other text ") * 3, float(i % 2))
                                  for i in range(40)], "doc_id long, text string, label double")
    model = rel.fit_classifier(docs)
    rel.save_model(model, str(tmp_path / "clf"))
    again = rel.load_model(str(tmp_path / "clf"))
    p1 = [r.prediction for r in rel.predict(model, docs).orderBy("doc_id").collect()]
    p2 = [r.prediction for r in rel.predict(again, docs).orderBy("doc_id").collect()]
    assert p1 == p2 == [i % 2 for i in range(40)]
    sents = spark.createDataFrame([(i, 0, ["new", "york", "is", "big"] if i % 3 else ["old", "new", "york"])
                                   for i in range(60)], "doc_id long, sent_no int, toks array<string>")
    merged, tables = ph.phrase_passes(sents, depth=2, min_count=2, threshold=0.1)
    em.save_phrase_tables(tables, str(tmp_path / "phr"))
    loaded = em.load_phrase_tables(spark, str(tmp_path / "phr"))
    replay = ph.make_phrases(sents, loaded)
    assert sorted(map(tuple, (r.toks for r in replay.collect()))) == \
        sorted(map(tuple, (r.toks for r in merged.collect())))


def test_search_filter_and_tag_scan(spark):
    from lexicor.operators.search import search_filter
    from lexicor.sources.providers import tagged_corpus
    df = spark.createDataFrame([("Journal", "Food", "Beef flavour study", ["set_1"]),
                                ("Book", "Food", "beef", ["set_1"]),
                                ("Journal", "Chem", "beef", ["x"])],
                               "type string, subject string, abstract string, tags array<string>")
    assert df.where(search_filter(df, subject="Food", keyword="BEEF")).count() == 1
    assert df.where(search_filter(df)).count() == 2
    scan = tagged_corpus(df.withColumnRenamed("abstract", "processed_abstract"), "set_1")
    assert scan.columns == ["processed_abstract"] and scan.count() == 2


def test_continue_training_refits_on_old_and_new(spark):
    from lexicor.operators import embeddings as em
    old = spark.createDataFrame([(["a", "b", "c", "d"],)] * 50, "toks array<string>")
    new = spark.createDataFrame([(["e", "f", "a", "b"],)] * 50, "toks array<string>")
    model = em.continue_training(old, new, dims=8, epochs=2, partitions=1, min_count=1)
    words = {r.word for r in em.word_vectors(model).collect()}
    assert words == {"a", "b", "c", "d", "e", "f"}


def test_prepare_with_classifier_tags_relevant_rows(spark, tmp_path):
    from lexicor.operators import relevance as rel
    from lexicor.plans.ingest import ingest, prepare
    from lexicor.sources import providers as pv
    train = spark.createDataFrame([(i, ("alloy steel iron carbon " if i % 2 else "poem song verse rhyme ") * 4,
                                    float(i % 2)) for i in range(60)], "doc_id long, text string, label double")
    model = rel.fit_classifier(train)
    lines = [{"paper_id": "1", "doi": "10.5/a", "abstract": "Alloy steel with iron and carbon."},
             {"paper_id": "2", "abstract": "A poem, a song and a verse."},
             {"paper_id": "3", "abstract": ""}]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    rows, rejected = prepare(pv.s2orc_articles(pv.read_s2orc(spark, str(tmp_path))), "s2orc", {"metal": model})
    store, per_key = ingest(None, rows)
    got = {(r.key_type, r.key): sorted(r.tags) for r in store.collect()}
    assert got == {("doi", "10.5/a"): ["metal"]}
    assert [r.reject_reason for r in rejected.collect()] == ["no_abstract"]


def test_fitted_classifier_does_not_carry_the_session(spark):
    from lexicor.operators import relevance as rel
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "bad text", float(i % 2)) for i in range(20)],
                                 "doc_id long, text string, label double")
    model = rel.fit_classifier(docs)
    assert not model.stages[-1].hasSummary
    assert [r.prediction for r in rel.predict(model, docs).orderBy("doc_id").collect()] == [i % 2 for i in range(20)]


def test_classifier_of_a_large_vocabulary_equals_spark_ml(spark, tmp_path):
    from lexicor.operators import logistic, relevance as rel
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 6 + i % 4)) + (" good" if i % 5 < 2 else " bad bad"),
                                   float(i % 5 < 2)) for i in range(120)] + [(-1, "", 0.0)], "doc_id long, text string, label double")
    ml, table = rel.fit_classifier(docs), rel.fit_classifier(docs, max_terms=1)
    assert isinstance(table, logistic.TermModel)
    wanted = dict(zip(ml.stages[1].vocabulary, ml.stages[-1].coefficients.toArray()))
    got = {r.term: r.weight for r in table.table.collect()}
    assert got.keys() == wanted.keys() and max(abs(got[t] - wanted[t]) for t in got) < 1e-2
    assert abs(table.intercept - ml.stages[-1].intercept) < 1e-2
    rel.save_model(table, str(tmp_path / "m"))
    new = spark.createDataFrame([(1, "good w3"), (2, "bad w1"), (3, "unseen"), (4, "")], "doc_id long, text string")
    for df in (docs, new):
        p = [{r.doc_id: r.prediction for r in rel.predict(m, df).collect()} for m in (ml, table, rel.load_model(str(tmp_path / "m")))]
        assert p[0] == p[1] == p[2]


class _State:
    """The part of Spark's keyed state that the stream's function uses."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def test_stream_state_serves_many_keys_and_holds_no_fields():
    import pandas as pd

    from lexicor.streaming.ingest import _changes
    state = _State()

    def batch(*rows):
        df = pd.DataFrame(rows, columns=["key_type", "key", "file", "block", "n", "row", "tags"])
        return {(r.key_type, r.key): (r.row, list(r.tags), r.version, r.is_new, list(r.added))
                for out in _changes((7,), iter([df.iloc[:2], df.iloc[2:]]), state) for r in out.itertuples()}

    assert batch(("doi", "k", "f1", 0, 5, "late", ["b"]), ("pmc", "k", "f1", 0, 2, "other", []),
                 ("doi", "k", "f1", 0, 1, "first", ["a"])) == {
        ("doi", "k"): ("first", ["a", "b"], 1, True, ["a", "b"]), ("pmc", "k"): ("other", [], 1, True, [])}
    # a known key keeps its fields, a key without further tags changes nothing
    assert batch(("doi", "k", "f0", 0, 0, "again", ["c", "a"]), ("pmc", "k", "f0", 0, 1, "again", [])) == {
        ("doi", "k"): (None, ["a", "b", "c"], 2, False, ["c"])}
    assert batch(("doi", "k", "f2", 0, 0, "again", ["a"])) == {}
    assert "first" not in state.get[0] and "other" not in state.get[0]


def test_stream_calls_its_state_for_groups_of_keys(spark, tmp_path):
    from lexicor.streaming import ingest as si
    src = tmp_path / "in"
    rows = [{"paper_id": f"p{i}", "title": f"t{i}", "abstract": f"Text {i}."} for i in range(3 * si.STATE_GROUPS)]
    _land(src, 0, rows)
    got = si.stream_s2orc(spark, str(src), str(tmp_path / "store"), str(tmp_path / "ckpt"), general_tag="general")
    assert {r.key: r.title for r in got.select("key", "title").collect()} == {x["paper_id"]: x["title"] for x in rows}
    known = spark.read.format("statestore").load(str(tmp_path / "ckpt"))
    assert known.count() <= si.STATE_GROUPS
