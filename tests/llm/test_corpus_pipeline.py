"""The pipeline against a plain version of every stage."""
import random

import numpy as np
import pyarrow as pa
import zstandard

import corpus_pipeline as cp
from lexicor.llm import langid, quality
from lexicor.llm.queries import PIECE_MODEL, language_model, quality_model, tokenizer_path
from test_pairs import brute_components, brute_contamination

SMALL = "/root/testdata/sf0.001"


def plain_run(spark, docs, sf_dir):
    """Expected {doc_id: ids}."""
    import sentencepiece

    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    m = quality_model(spark, docs, sf_dir)
    x = quality.features(pa.array([t for _, t in rows], pa.string()), quality._tables())
    z = (x - m.mean) / m.scale @ m.weights + m.bias
    rows = [r for r, s in zip(rows, z) if 1 / (1 + np.exp(-s)) >= 0.3]
    left = docs.where(docs["doc_id"].isin([i for i, _ in rows]))
    packers = [zstandard.ZstdCompressor(level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                                        dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
               for d in language_model(left).dictionaries.values()]

    def settled(text):
        blocks = list(langid._blocks(text or ""))
        if not blocks:
            return False
        a, b = sorted(sum(len(p.compress(x)) for x in blocks) for p in packers)[:2]
        return (b - a) / a >= langid.MARGIN

    rows = [r for r in rows if settled(r[1])]
    keep = {c for _, _, c in brute_components(rows, 80, 5)}
    rows = [r for r in rows if r[0] in keep]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _, n, _ in brute_contamination(rows, items) if n}
    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    return {i: own.encode(t) for i, t in rows if i not in bad}


def small_tables(spark, tmp_path):
    """The first documents of the small tables with copies and passages."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 1500").collect()
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(4).collect()]
    rng = random.Random(1)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs]
    top = max(r[0] for r in rows) + 1
    for k in range(25):
        i, text, lang, source, n = rng.choice(rows)
        w = text.split(" ")
        if k % 3 == 1:
            w[rng.randrange(len(w))] = "changed"
        if k % 3 == 2:
            w.insert(rng.randrange(len(w)), items[k % 4])
        rows.append((top + k, " ".join(w), lang, source, n))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        t = spark.read.parquet(f"{SMALL}/{name}.parquet")
        (t.limit(4) if name == "benchmark" else t).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_run_equals_the_plain_version(spark, tmp_path):
    sf_dir = small_tables(spark, tmp_path)
    want = plain_run(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    got = {r["doc_id"]: r["ids"] for r in cp.run(spark, sf_dir).collect()}
    assert got == want and 20 < len(got) < 140


def test_stages_keep_the_columns_and_survive_odd_rows(spark, tmp_path):
    sf_dir = small_tables(spark, tmp_path)
    extra = "doc_id long, text string, lang string, source string, n_chars long, score int, key string, row int, component_id int"
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect()
    rows = [(*r, 1, "k", 2, 3) for r in base]
    rows += [(None, rows[0][1], None, None, None, None, None, None, None), (900, None, *[None] * 7), (901, "", *[None] * 7), (901, "", *[None] * 7),
             (902, "zu " + "der die das und " * 40_000, "de", "s", 1, 1, "k", 1, 1), (rows[3][0], rows[4][1], *[None] * 7)]
    docs = spark.createDataFrame(rows, extra)
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.schema.names == docs.columns, name
        assert got.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert cp.encode_pieces(spark, docs, sf_dir).count() == len(rows)


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "benchmark decontamination",
                                         "SentencePiece encoding and decoding"]
    assert cp.ORACLE_SQL is None


def test_rows_of_one_id_are_compared_as_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, text), (5, other), (5, text), (2, text + " more"), (None, other), (None, "a third text of six words"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, cp.keep_one_of_each(spark, docs, SMALL).collect()), key=str)
    assert got == sorted([(2, text + " more"), (5, other), (None, "a third text of six words"), (9, None), (9, "")], key=str)


def test_near_copies_by_five_words(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(20)) for _ in range(rng.choice([30, 50, 90]))]
        for n in (0, 1, 1, 2, 4):
            w = list(base)
            for _ in range(n):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    grams = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    first = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                x, y = sorted((first[a], first[b]))
                first = [x if f == y else f for f in first]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in cp.keep_one_of_each(spark, docs, SMALL).collect())
    assert got == sorted(set(first)) and got != sorted({c for _, _, c in brute_components(rows)})


def test_last_stage_decodes(spark):
    import sentencepiece

    texts = ["Two plain words", "two  blanks", " leading", "ﬁ Ⅳ ｆｕｌｌ", "tab\there", "日本 é", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    got = {r["doc_id"]: (r["ids"], r["round_trip"]) for r in cp.STAGES[-1][1](spark, docs, SMALL).collect()}
    assert got == {i: (own.encode(t or ""), own.decode(own.encode(t or "")) == (t or "")) for i, t in enumerate(texts)}
    assert got[0][1]
