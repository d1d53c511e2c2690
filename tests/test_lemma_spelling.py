"""Learned lemmatiser and ordered spelling replacement."""
import random
import time
from collections import Counter

import pytest

from lexicor.operators import lemma_trees as lt
from lexicor.operators import spelling

PAIRS = [("walked", "walk"), ("jumped", "jump"), ("helped", "help"), ("tried", "try"), ("carried", "carry"), ("boxes", "box"),
         ("foxes", "fox"), ("cats", "cat"), ("dogs", "dog"), ("trees", "tree"), ("running", "run"), ("sitting", "sit"),
         ("went", "go"), ("better", "good"), ("walk", "walk"), ("dog", "dog"), ("iron", "iron"), ("water", "water"), ("air", "air"),
         ("oxide", "oxide"), ("stop", "stop"), ("green", "green"), ("phase", "phase"), ("geschrieben", "schreiben"), ("gegeben", "geben")]


def plain_resolve(pairs, forms, longest=lt.SUFFIX):
    lemmas = {}
    for f, x in pairs:
        if f and x is not None:
            lemmas.setdefault(f, Counter())[x] += 1
    lexicon = {f: min(c, key=lambda x: (-c[x], x)) for f, c in lemmas.items()}
    rules = {}
    for f, x in lexicon.items():
        tree = lt.json.dumps(lt.edit_tree(f, x), separators=(",", ":"))
        for k in range(min(longest, len(f)) + 1):
            rules.setdefault(f[len(f) - k:], Counter())[tree] += 1
    out = {}
    for f in forms:
        if f in lexicon:
            out[f] = (lexicon[f], True)
            continue
        out[f] = (f, False)
        for k in range(min(longest, len(f)), -1, -1):
            c = rules.get(f[len(f) - k:])
            got = c and lt.apply_tree(lt.json.loads(min(c, key=lambda t: (-c[t], t))), f)
            if got is not None and c:
                out[f] = (got, False)
                break
    return out


def test_edit_trees_give_the_lemma_back():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 8))) for _ in range(120)]
    for a in words:
        for b in words[:40]:
            assert lt.apply_tree(lt.edit_tree(a, b), a) == b
    assert lt.apply_tree(lt.edit_tree("geschrieben", "schreiben"), "gegeben") is None
    assert lt.common_part("xabyab", "ab") == (1, 0, 2) and lt.common_part("a", "b") == (0, 0, 0)


def test_unseen_inflections(spark):
    rng = random.Random(2)
    extra = [("".join(rng.choice("abst") for _ in range(rng.randint(1, 7))), "".join(rng.choice("abst") for _ in range(3))) for _ in range(80)]
    pairs = PAIRS * 2 + extra + [("cats", "cats"), ("", "x"), (None, "y"), ("z", None)]
    forms = [f for f, _ in pairs if f] + ["talked", "cried", "mixes", "birds", "planning", "stones", "x", "", "baab", "ssst", "walked", "Ätas"]
    df = spark.createDataFrame(pairs, "form string, lemma string")
    model = lt.induce(df)
    got = {r["form"]: (r["lemma"], r["known"]) for r in lt.resolve(spark.createDataFrame([(f, 1) for f in [*forms, None]], "form string, lemma int"), model).collect()}
    assert got == plain_resolve(pairs, forms)
    clean = lt.induce(spark.createDataFrame(PAIRS, "form string, lemma string"))
    unseen = {r["form"]: r["lemma"] for r in lt.resolve(spark.createDataFrame([(f,) for f in ("talked", "cried", "mixes", "birds", "planet")], "form string"), clean).collect()}
    assert unseen == {"talked": "talk", "cried": "cry", "mixes": "mix", "birds": "bird", "planet": "planet"}


def test_empty_lexicon(spark):
    pairs = spark.createDataFrame(PAIRS, "form string, lemma string")
    model = lt.induce(pairs.limit(0))
    assert [tuple(r) for r in lt.resolve(pairs.limit(1), model).collect()] == [("walked", "walked", False)]
    assert lt.resolve(pairs.limit(0), lt.induce(pairs)).count() == 0


def plain_fold(text, pairs):
    for form, other in pairs:
        text = text.replace(form, other)
    return text


def test_fold_equals_the_ordered_replacement():
    rng = random.Random(3)
    for _ in range(300):
        pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 4))))
                 for _ in range(rng.randint(0, 25))]
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 40)))
        assert spelling.Folder(pairs).fold(text) == plain_fold(text, pairs)


def test_a_hundred_thousand_pairs():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = [("".join(rng.choice(letters) for _ in range(rng.randint(4, 9))), "".join(rng.choice(letters) for _ in range(rng.randint(2, 9))))
             for _ in range(100_000)]
    texts = [" ".join(rng.choice(pairs)[rng.randrange(2)] + rng.choice(letters) for _ in range(60)) for _ in range(10)]
    folder = spelling.Folder(pairs)
    t = time.time()
    got = [folder.fold(x) for x in texts]
    fast = time.time() - t
    t = time.time()
    assert got == [plain_fold(x, pairs) for x in texts]
    assert 3 * fast < time.time() - t


@pytest.mark.parametrize("block", [spelling.BLOCK_PAIRS, 2])
def test_fold_of_a_table(spark, block):
    pairs = [(3, "or", "our"), (1, "colour", "color"), (2, "xx", ""), (5, "", "y"), (6, None, "y"), (7, "q", None), (4, "our", "OUR"), (9, "é", "e")]
    table = spark.createDataFrame(pairs, "pos int, gb string, us string")
    texts = ["colour", "xxcolxxour", None, "", "q or é", "flavour" * 3000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, folded string")
    got = {r["doc_id"]: (r["text"], r["folded"]) for r in spelling.fold_spelling(docs, table, out_col="folded", block_pairs=block).collect()}
    order = [(g, u) for _, g, u in sorted((p for p in pairs if p[1] and p[2] is not None))]
    assert got == {i: (t, None if t is None else plain_fold(t, order)) for i, t in enumerate(texts)}
    assert spelling.fold_spelling(docs.limit(0), table).count() == 0
    assert {r["text"] for r in spelling.fold_spelling(docs, table.limit(0)).collect()} == set(texts)
