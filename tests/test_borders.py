"""Learned sentence borders."""
import math
import random
from collections import Counter

import pytest

from lexicor.operators import borders


def corpus(n=400):
    rng = random.Random(4)
    words = ["iron", "oxide", "sample", "was", "heated", "slowly", "the", "phase", "grows", "in", "air", "water"]
    names = ["Smith", "Jones", "Meyer"]
    out = []
    for i in range(n):
        s = [rng.choice(words) for _ in range(rng.randint(3, 8))]
        s[0] = s[0].capitalize()
        extra = rng.choice([f"Dr. {rng.choice(names)}", f"{rng.choice(names)} et al. {rng.randint(1990, 2020)}", f"Fig. {i % 9}", "e.g. water", "", ""])
        out.append(" ".join([*s[:2], extra, *s[2:]]).replace("  ", " ") + ".")
    return [" ".join(out[i:i + 4]) for i in range(0, n, 4)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sentences string")


def learned(spark, texts):
    counts = borders.type_counts(frame(spark, texts))
    return counts, borders.abbreviations(counts), borders.starters(counts)


def test_counts_and_scores_equal_a_plain_version(spark):
    texts = corpus() + [None, "", "...", "(cf. x) \"Quoted,\" End!", "tab\there.\r\nNext"]
    counts, abbr, _ = learned(spark, texts)
    want = {}
    for t in texts:
        for line in (t or "").split("\n"):
            chunks = [c for c in __import__("re").split(r"[ \t\r]+", line) if c]
            for k, c in enumerate(chunks):
                bare = borders._EDGES.sub("", c)
                kind = borders._type_of(c)
                if not any(x.isalpha() for x in kind):
                    continue
                row = want.setdefault(kind, Counter())
                row["stopped" if bare.endswith(".") else "plain"] += 1
                row["lower"] += bare[0].islower()
                row["inner"] += bare[0].isupper() and k > 0 and chunks[k - 1][-1] not in ".!?"
    got = {r["word"]: r for r in counts.collect()}
    assert set(got) == set(want)
    for w, row in want.items():
        assert [got[w][c] for c in ("stopped", "plain", "lower", "inner")] == [row[c] for c in ("stopped", "plain", "lower", "inner")], w
    n, stops = sum(r["stopped"] + r["plain"] for r in want.values()), sum(r["stopped"] for r in want.values())
    scores = {}
    for w, r in want.items():
        dots = w.count(".")
        size = len(w) - dots
        def ll(q):
            return r["stopped"] * math.log(q) + r["plain"] * math.log(1 - q)
        score = 2 * (ll(0.99) - ll(stops / n)) * math.exp(-size) * (dots + 1) * float(size) ** -r["plain"]
        if r["stopped"] and score >= 0.3:
            scores[w] = round(score, 9)
    assert {r["word"]: round(r["score"], 9) for r in abbr.collect()} == scores
    assert {"dr", "al", "fig", "e.g"} <= set(scores) and not {"air", "water", "phase", "iron"} & set(scores)


@pytest.mark.parametrize("max_rows", [borders.MAX_BROADCAST_ROWS, 2])
def test_abbreviations_keep_sentences_whole(spark, max_rows):
    _, abbr, begins = learned(spark, corpus())
    texts = ["Dr. Smith heated iron. The phase grows.", "As in Smith et al. 2019 the phase grows. Water was in air!",
             "See Fig. 3 in air. Slowly it grows? Yes.", "Heated, e.g. water in air.\nA new line. ",
             "We saw Smith et al. The sample was heated.", "Plain iron. Oxide grows.", None, "", " .  . ", "No stop",
             "Dr. Smith and Dr. Jones. Dr. Meyer."]
    got = {r["doc_id"]: r["sentences"] for r in borders.split_sentences(frame(spark, texts), abbr, begins, max_rows=max_rows).collect()}
    assert got[0] == ["Dr. Smith heated iron.", "The phase grows."]
    assert got[1] == ["As in Smith et al. 2019 the phase grows.", "Water was in air!"]
    assert got[2] == ["See Fig. 3 in air.", "Slowly it grows?", "Yes."]
    assert got[3] == ["Heated, e.g. water in air.", "A new line."]
    assert got[4] == ["We saw Smith et al.", "The sample was heated."]
    assert got[5] == ["Plain iron.", "Oxide grows."]
    assert got[6] == got[7] == [] and got[8] == [".", "."] and got[9] == ["No stop"]
    assert got[10] == ["Dr. Smith and Dr. Jones.", "Dr. Meyer."] or got[10] == ["Dr. Smith and Dr. Jones. Dr. Meyer."]


def test_without_a_corpus(spark):
    docs = frame(spark, ["One. Two."])
    counts = borders.type_counts(docs.limit(0))
    abbr = borders.abbreviations(counts)
    assert abbr.count() == 0
    assert borders.split_sentences(docs, abbr, borders.starters(counts)).first()["sentences"] == ["One.", "Two."]
    assert borders.split_sentences(docs.limit(0), abbr, abbr).count() == 0
