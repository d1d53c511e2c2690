"""Golden rows for the token functions (documented examples of the original)."""
import random

from pyspark.sql import functions as F

from conftest import col_values
from lexicor.functions import materials as mat
from lexicor.functions import text as tx


def test_unit_and_oxidation_split(spark):
    got = col_values(spark, mat.split_token(F.col("t")), ["5V", "5Q", "Fe(II)", "iron(iii)", "10mA", "Fe()"])
    assert got == [["5", "V"], ["5Q"], ["Fe", "(II)"], ["iron", "(iii)"], ["10", "mA"], ["Fe()"]]


def test_compat_oxidation_pattern_keeps_original_quirk(spark):
    got = col_values(spark, mat.split_token(F.col("t"), compat=True), ["Fe(IV)", "Fe()", "Fe(II)"])
    assert got == [["Fe(IV)"], ["Fe", "()"], ["Fe", "(II)"]]


def test_number_test(spark):
    vals = ["5", ".5", "-3", "1.2(3)", "1,000", "5.", "1e5"]
    assert col_values(spark, tx.is_number(F.col("t")), vals) == [True] * 5 + [False] * 2


def test_formula_test_and_normalisation(spark):
    vals = ["LiFePO4", "IrMn", "O2", "LiFePxO4-x", "IV", "BN", "Fe", "Fe(II)"]
    assert col_values(spark, mat.is_simple_formula(F.col("t")), vals) == [True, True, True] + [False] * 5
    norm = col_values(spark, mat.normalized_formula(F.col("t")), ["Ni0.5Fe0.5", "Fe4O6", "C6H12O6", "O2"])
    assert norm == ["FeNi", "Fe2O3", "CH2O", "O"]


def test_normalised_formula_is_fixed_point(spark):
    vals = ["Ni0.5Fe0.5", "LiFePO4", "Fe4O6", "Ba0.25Sr0.75TiO3"]
    once = col_values(spark, mat.normalized_formula(F.col("t")), vals)
    twice = col_values(spark, mat.normalized_formula(F.col("t")), once)
    assert once == twice


def test_element_names_selective_lower_and_accents(spark):
    assert col_values(spark, mat.element_name_symbol(F.col("t")), ["Iron", "iron", "IRON"]) == ["Fe", "Fe", None]
    got = col_values(spark, tx.lower_candidate(F.col("t")), ["The", "DNA", "Fe", "K", "a", "Si(111)"])
    assert got == [True, False, False, False, True, False]
    assert col_values(spark, tx.remove_accents(F.col("t")), ["Néel", "Å", "straße"]) == ["Neel", "Å", "strasse"]


def test_number_mask_and_mentions(spark):
    df = spark.createDataFrame([(["a", "5", "b", "(", "111", ")", "Iron", "Ni0.5Fe0.5", "The", "5"],)],
                               "t array<string>")
    steps = tx.process_tokens(F.col("t"))
    row = df.select(tx.processed(steps).alias("p"), tx.mentions(steps).alias("m")).first()
    assert row.p == ["a", "<nUm>", "b", "(", "111", ")", "iron", "FeNi", "the", "<nUm>"]
    assert [(m.original, m.normalized) for m in row.m] == [("Iron", "Fe"), ("Ni0.5Fe0.5", "FeNi")]


def test_first_token_has_no_wrapping_neighbour(spark):
    df = spark.createDataFrame([(["5", ")", "("],)], "t array<string>")
    row = df.select(tx.processed(tx.process_tokens(F.col("t"))).alias("p")).first()
    assert row.p[0] == "<nUm>"


def test_sentences_tokens_and_paragraph_marker(spark):
    got = col_values(spark, tx.sentences(tx.mark_paragraphs(F.col("t"))), ["One. ::: Two.", "A b. C d!  E\nF"])
    assert got == [["One.", "Two."], ["A b.", "C d!", "E", "F"]]
    toks = col_values(spark, tx.tokens(F.col("t")), ["The colour of 5V cells (111) at 1,000 K."])
    assert toks == [["The", "colour", "of", "5", "V", "cells", "(", "111", ")", "at", "1,000", "K", "."]]


def test_stop_words_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["The", "cat", "and", "the", "cat"],)], "t array<string>")
    assert df.select(tx.remove_stop_words(F.col("t"))).first()[0] == ["cat", "cat"]


def test_spelling_is_ordered_substring_replacement(spark):
    from lexicor.operators.lemmas import spelling_table
    df = tx.attach_spelling(spark.createDataFrame([("colours of the centre",)], "t string"),
                            spelling_table(spark, [("colour", "color"), ("centre", "center")]))
    assert df.select(tx.fold_spelling(F.col("t"), F.col("_spelling"))).first()[0] == "colors of the center"


def test_markup_strip_and_compat(spark):
    from lexicor.functions.markup import strip_markup
    vals = ["foo <b>bar</b> baz", "<i>f(x)</i>", " p < 0.05 and x > 3"]
    assert col_values(spark, strip_markup(F.col("t")), vals) == ["foo bar baz", "f(x)", " p < 0.05 and x > 3"]
    assert col_values(spark, strip_markup(F.col("t"), compat=True), vals) == ["foo baz", "f(x)", " p 3"]


def test_term_display_and_label(spark):
    from lexicor.functions.terms import display_term, query_label
    assert col_values(spark, display_term(F.col("t")), ["soy_-_based_food"]) == ["soy-based food"]
    df = spark.createDataFrame([("flavor", [("plant", True), ("animal", False)])],
                               "term string, vectors array<struct<term:string,positive:boolean>>")
    assert df.select(query_label(F.col("term"), F.col("vectors"))).first()[0] == "flavor + plant - animal"


def test_formulas_with_groups(spark):
    toks = col_values(spark, tx.tokens(F.col("t")), ["Ca(OH)2 in water, Fe(III) and Si(111) word(s)"])
    assert toks == [["Ca(OH)2", "in", "water", ",", "Fe", "(III)", "and", "Si(111)", "word", "(", "s", ")"]]
    vals = ["Ca(OH)2", "Mg(NO3)2", "Fe(III)"]
    assert col_values(spark, mat.is_simple_formula(F.col("t")), vals) == [True, True, False]
    assert col_values(spark, mat.normalized_formula(F.col("t")), vals[:2]) == ["CaH2O2", "MgN2O6"]


def test_nested_groups_and_long_division():
    assert mat.composition("Mg(Fe(CN)6)2") == {"Mg": 1.0, "Fe": 2.0, "C": 12.0, "N": 12.0}
    assert mat.composition("Ca(OH") is None and mat.composition("Ca)OH(") is None and mat.composition("()Fe") is None
    # 76 division steps, common divisor 1
    assert mat.integer_formula(mat.composition("Fe8944394323791464O5527939700884757")) == \
        "Fe8944394323791464O5527939700884757"
    assert mat.integer_formula({"Fe": 1e40, "O": 2e40}) == "FeO2"


def test_formula_amount_overflow_rejects(spark):
    from lexicor.operators import corpus
    rows = [(1, "Sample of Fe" + "9" * 400 + "O2 here."), (2, "Sample of Mg(Fe(CN)6)2 and Fe2O4."), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for recipe in ("api", "loader", "s2orc"):
        got = {r.doc_id: r for r in corpus.normalise(docs, recipe).collect()}
        assert got[1].unprocessable and not got[2].unprocessable
    got = {r.doc_id: r for r in corpus.normalise(docs, "api").collect()}
    assert got[2].processed_abstract == "sample of C12Fe2MgN12 and FeO2 ."
    assert got[3].processed_abstract is None and got[4].processed_abstract == ""


def test_lemma_join_path_equals_broadcast_path(spark):
    df = spark.createDataFrame([(1, ["cats", "and", "dogs"]), (2, []), (3, ["dog", "cats"])],
                               "id int, toks array<string>")
    lem = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "form string, lemma string")
    a = {r.id: r.toks for r in tx.lemmatize_column(df, "toks", lem).collect()}
    b = {r.id: r.toks for r in tx.lemmatize_column(df, "toks", lem, max_rows=0).collect()}
    assert a == b == {1: ["cat", "and", "dog"], 2: [], 3: ["dog", "cat"]}


def test_recipes_beyond_the_dictionary_bound(spark, monkeypatch):
    from lexicor.operators import corpus
    from lexicor.operators.lemmas import spelling_table
    docs = spark.createDataFrame([(1, "The cats sat. Colours of dogs!"), (1, "The cats sat. Colours of dogs!"), (2, ""), (3, None),
                                  (4, "a. the")], "doc_id long, text string")
    lem = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("dog", "hound")], "form string, lemma string")
    spelled = tx.attach_spelling(docs, spelling_table(spark, [("olour", "olor")]))

    def run(recipe):
        out = corpus.normalise(spelled, recipe, lemma_table=lem, spelling=F.col("_spelling"))
        return sorted(((r.doc_id, r.processed_abstract) for r in out.collect()), key=str)

    near = {r: run(r) for r in ("loader", "s2orc")}
    assert near["s2orc"][0] == (1, "cat sat .\nColors dog !")
    monkeypatch.setattr(tx.lemmatize_column, "__defaults__", (0, False))
    assert {r: run(r) for r in ("loader", "s2orc")} == near


def test_process_text_options(spark):
    from lexicor.operators import corpus
    from lexicor.operators import phrases as ph
    docs = spark.createDataFrame([(1, "The New York sample Fe(III) of New York."), (2, None)], "doc_id long, text string")
    table = spark.createDataFrame([(ph.SEP.join(["new", "york"]),), (ph.SEP.join(["new_york", "sample"]),)], "ckey string")
    got = {r.doc_id: r.processed for r in corpus.process_text(docs, phrase_table=table).collect()}
    assert got[1] == ["the", "new_york_sample", "Fe", "(III)", "of", "new_york", "."] and got[2] is None
    whole = {r.doc_id: r.processed for r in corpus.process_text(docs, split_oxidation=False).collect()}
    assert whole[1][4] == "Fe(III)"


def test_transliteration_of_greek_and_wide_letters(spark):
    got = col_values(spark, tx.remove_accents(F.col("t")), ["αβ", "ΘΕ", "ώρα", "Ｆｅ", "ệm", "α"])
    assert got == ["ab", "ThE", "ora", "Fe", "em", "α"]


def test_spelling_by_token(spark):
    from lexicor.operators.lemmas import spelling_table
    df = tx.attach_spelling(spark.createDataFrame([(["col", "our", "colour"],)], "t array<string>"),
                            spelling_table(spark, [("colour", "color"), ("lour", "x")]))
    assert df.select(tx.fold_spelling_tokens(F.col("t"), F.col("_spelling"))).first()[0] == ["col", "our", "color"]


def test_recipes_with_a_spelling_table(spark):
    from lexicor.operators import corpus
    from lexicor.operators.lemmas import spelling_table
    docs = spark.createDataFrame([(1, "The colours. Of olourr!\nCentre"), (2, ""), (3, None)], "doc_id long, text string")
    table = spelling_table(spark, [("olour", "olor"), ("lorr", "x"), ("entre", "enter")])
    attached = tx.attach_spelling(docs, table)
    for recipe in ("loader", "s2orc"):
        want = corpus.normalise(attached, recipe, spelling=F.col("_spelling")).select("doc_id", "processed_abstract").collect()
        got = corpus.normalise(docs, recipe, spelling=table).select("doc_id", "processed_abstract").collect()
        assert sorted(got, key=str) == sorted(want, key=str)
    articles = attached.select("doc_id", F.col("text").alias("processed_abstract"), F.array(F.lit("t")).alias("tags"), "_spelling")
    want = corpus.clean_corpus(articles, "t", spelling=F.col("_spelling")).collect()
    assert sorted(corpus.clean_corpus(articles.drop("_spelling"), "t", spelling=table).collect(), key=str) == sorted(want, key=str)


def test_formula_table_is_beside_the_tokens(spark):
    """An entry for every token: no search of a row's other formulas."""
    df = spark.createDataFrame([([["Fe2O3", "and", "NaCl"], [], ["of"], ["Fe2O3"]],), (None,), ([None, [None, "H2O"]],)], "toks array<array<string>>")
    names = [[None if r is None else [x and x["normalized"] for x in r] for r in row[0]]
             for row in df.select(mat.formula_table(F.col("toks"), nested=True)).collect()]
    assert names == [[["Fe2O3", None, "ClNa"], [], [None], ["Fe2O3"]], [], [[], [None, "H2O"]]]


def test_fast_tokens_and_sentences_equal_the_plain_patterns(spark):
    assert tx.FAST_TOKEN_RE != tx.TOKEN_RE
    rng = random.Random(3)
    signs = [*"aZé1(),.:;% \t\r\n\u0085  µΩFeIVx23.5+-", "Fe(II)", "5V", "Ca(OH)2", "3.5 K", "Si(111)", "x1.2(3)"]
    texts = [None, ""] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = mat.split_tokens(F.regexp_extract_all("t", F.lit(tx.TOKEN_RE), 0))
    lines = F.split(F.regexp_replace("t", tx.SENTENCE_END_RE, "$1\n"), "\n")
    cut = F.filter(F.transform(lines, lambda s: F.regexp_replace(s, tx.EDGE_BLANKS_RE, "")), lambda s: s != "")
    assert df.where(~plain.eqNullSafe(tx.tokens(F.col("t"))) | ~cut.eqNullSafe(tx.sentences(F.col("t")))).count() == 0


def test_overflow_of_token_lists_equals_the_formula_table(spark):
    long = "9" * 160
    lists = [[["Fe2O3", "iron"], []], [["a"], ["Fe" + "9" * 400 + "O"]], [[f"(Fe{long}O){long}"]], [[f"(Fe{long}O)2"]],
             [["9" * 400, "é" * 150, None]], [], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, toks array<array<string>>")
    plain = F.exists(mat.formula_table(F.flatten("toks")), lambda x: F.coalesce(x["overflow"], F.lit(False)))
    rows = df.withColumn("plain", plain).withColumn("found", mat.any_overflow(F.col("toks"))).orderBy("i").collect()
    assert [r.found for r in rows] == [r.plain for r in rows] == [False, True, True, False, False, False, False]


def test_overflow_sends_only_long_tokens_to_python(spark):
    df = spark.createDataFrame([([["Fe2O3", "NaCl", "a" * 300]],)], "toks array<array<string>>")
    sent = []
    table, mat.formula_table = mat.formula_table, lambda toks: (sent.append(toks), table(toks))[1]
    try:
        df.select(mat.any_overflow(F.col("toks")))
    finally:
        mat.formula_table = table
    assert df.select(sent[0]).first()[0] == ["a" * 300]


def test_tokens_without_digits_equal_the_full_pattern(spark):
    texts = ["Plain words, here.", "x.٣b y,٤ z.-", "Fe) été Ünï", "A)B [C] {d} e f\x0bg", "a._b, 中文。", "", "١٢ ½ Ⅳ x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(tx.tokens(F.col("t")).alias("got"), F.regexp_extract_all("t", F.lit(tx.TOKEN_RE), F.lit(0)).alias("want")).collect():
        assert r.got == r.want


def _by_columns(df, **flags):
    """The api recipe by Column expressions alone."""
    from lexicor.operators import corpus

    staged = df.withColumn("_stoks", F.transform(tx.sentences(F.col("text")), lambda s: tx.tokens(s)))
    staged = staged.withColumn("_table", mat.formula_table(F.col("_stoks"), nested=True))
    steps = staged.withColumn("_steps", corpus.process_sentences(F.col("_stoks"), F.col("_table"), **flags))
    return steps.select("doc_id", F.array_join(F.transform("_steps", lambda st: F.array_join(tx.processed(st), " ")), "\n").alias("processed_abstract"),
                        F.flatten(F.transform("_steps", tx.mentions)).alias("materials"), F.exists("_steps", corpus.overflow).alias("unprocessable"))


def test_ascii_texts_equal_the_column_expressions(spark):
    from lexicor.operators import corpus

    rng = random.Random(11)
    big = "Fe" + "9" * 400 + "O2"
    pieces = ["LiFePO4", "Ni0.5Fe0.5", "Iron", "iron", "IRON", "Fe(II)", "iron(iii)", "Fe(IV)", "5V", "5Q", "1.2(3)", "1,000", "(", ")", "111", "Si(111)",
              "Ca(OH)2", "Mg(Fe(CN)6)2", "Fe(O2", "))", ".", "!", "?", ", ", "K", "The", "the", "DNA", "O2", "H", "IV", "BN", ":::", "\t", "\r", "\n", "\x0b",
              "\x00", "\x1c", "a.5", ".5", "-3", "5.", "1e5", "a..b", "x_y", "(5 K)", "( 111 )", "10mg", "2.5kV", "Co2", "CO2", "He2O", "N2", "Salt", "lead", "Lead", big,
              "Fe(9)99O2", "  ", "e.g.", "Al2(SO4)3.5", "S(vi)", "(VI)", "3(2)eV"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", " ", ". ", "\n"]) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    texts += [None, "", " ", "\n\n", "Iron. ", "K", "One. Two! Three?\tFour", "café of LiFePO4 and Iron. 5 K.", "αFe2O3 (111)", big, "  a. b", "5Ω 5 Ω"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    for flags in ({}, {"exclude_punct": True}, {"convert_num": False}, {"normalize_materials": False, "accents": False}):
        got = {r.doc_id: r[1:] for r in corpus.normalise(df, "api", **flags).select("doc_id", "processed_abstract", "materials", "unprocessable").collect()}
        want = {r.doc_id: r[1:] for r in _by_columns(df, **flags).collect()}
        assert [texts[i] for i in want if got[i] != want[i]] == []
    assert sum(r[2] is True for r in got.values()) > 50 and sum(len(r[1] or ()) for r in got.values()) > 2000


def test_ascii_results_that_nobody_reads_are_not_made(spark):
    from lexicor.operators import corpus

    df = spark.createDataFrame([(1, "Iron of LiFePO4.")], "doc_id int, text string")
    plan = corpus.normalise(df, "api").select("doc_id", "unprocessable")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(") == 1
