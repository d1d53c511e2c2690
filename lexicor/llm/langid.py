"""Language identification by compression.

Every language has a zstandard raw-content dictionary: normalised text
(lower case, letters only) of a bounded sample of its documents. A text is
cut into blocks, each block is compressed with each dictionary, and the
language with the smallest total wins. The margin is the share by which the
runner-up is larger; narrow margins are rejected.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import widened

#: Dictionary bytes of a language, and the documents sampled to fill it.
DICTIONARY_BYTES = 32_768
SAMPLE_DOCS = 200
#: Only documents up to this size are sampled for dictionaries.
SAMPLE_DOC_BYTES = 65_536
#: Bytes compressed at once; a text of any length is worked through in blocks.
BLOCK_BYTES = 4_096
LEVEL = 5
#: Smaller margins are rejected: the runner-up packs the text as well.
MARGIN = 0.002
#: Characters normalised at once.
SLICE_CHARS = 1 << 20
UNDETERMINED = "und"

#: Most languages a model can have: that bounds what is collected and broadcast.
MAX_LANGUAGES = 1_000


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language."""

    dictionaries: dict[str, bytes]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> LanguageModel:
    """Dictionaries from the documents of ``docs`` that have a text and a
    language: of every language ``sample_docs`` documents or somewhat more,
    picked by a hash of their id, and of their text ``dictionary_bytes``."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_DOC_BYTES))
    sizes = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    known_sizes = sizes.limit(MAX_LANGUAGES + 1).collect()
    if len(known_sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rate = [(F.col(lang_col) == r["lang"])
            & (F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < 1_000_003.0 * 2 * sample_docs / r["n"])
            for r in known_sizes]
    if not rate:
        return LanguageModel({})
    pick = rate[0]
    for r in rate[1:]:
        pick = pick | r
    rows = (known.where(pick).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
            .limit(4 * sample_docs * len(rate)).collect())  # about twice sample_docs a language
    pieces: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["text"])):
        pieces.setdefault(r["lang"], []).append(b" ".join(_blocks(r["text"])))
    out = {}
    for lang, texts in pieces.items():
        share = max(64, dictionary_bytes // len(texts))
        body = b" ".join(t[len(t) // 3:len(t) // 3 + share] for t in texts)
        if len(body) < dictionary_bytes:
            body = b" ".join(texts)
        out[lang] = body[:dictionary_bytes]
    return LanguageModel({k: v for k, v in out.items() if len(v) >= 8})


def _letters(text: str) -> str:
    """Lower-cased words of letters (``str.isalpha``, so no numerals such as
    U+00B2) and the marks that follow them (vowel signs, accents)."""
    text = text.lower()
    odd = [c for c in set(text) if not "a" <= c <= "z"]
    marks = "".join(c for c in odd if unicodedata.category(c)[0] == "M")
    text = text.translate({ord(c): " " for c in odd if not c.isalpha() and c not in marks})
    if marks:  # a mark without a letter before it is no letter
        text = re.sub(f"(?:^|(?<= ))[{re.escape(marks)}]+", " ", text)
    return " ".join(text.split())


def _blocks(text: str):
    """The letters of the text, with their combining marks, in blocks of
    about ``BLOCK_BYTES``; none if it has no letter."""
    for a in range(0, len(text), SLICE_CHARS):
        flat = _letters(text[a:a + SLICE_CHARS]).encode("utf-8", "replace")
        for b in range(0, len(flat), BLOCK_BYTES):
            yield flat[b:b + BLOCK_BYTES]


def classify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1: 0.5 for a margin of
    nothing, near 1 for a wide one) and ``lang_accepted``.

    A null text, one without a letter, and every text if the model knows no
    language, are ``und``, score 0 and rejected. Ties go to the language that
    comes first by name. Columns of ``docs`` of these three names are
    replaced; all others are kept as they are."""
    new = ["lang_pred", "score", "lang_accepted"]
    kept = docs.drop(*new)
    names = kept.columns
    at = names.index(text_col)
    table = docs.sparkSession.sparkContext.broadcast(model.dictionaries)  # DICTIONARY_BYTES a language
    schema = widened(kept.schema, lang_pred="string", score="double", lang_accepted="boolean")

    def run(batches):
        import zstandard

        packers = {}
        for lang, content in sorted(table.value.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                     write_checksum=False, write_dict_id=False).compress
        for batch in batches:
            langs, scores, fine = [], [], []
            for text in batch.column(at):
                text = text.as_py()
                sizes = dict.fromkeys(packers, 0)
                empty = True
                for block in _blocks(text or ""):
                    empty = False
                    for lang, pack in packers.items():
                        sizes[lang] += len(pack(block))
                if empty or not packers:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    fine.append(False)
                    continue
                order = sorted(sizes.items(), key=lambda x: x[1])
                best, least = order[0]
                wide = 1.0 if len(order) == 1 else (order[1][1] - least) / least
                langs.append(best)
                scores.append(0.5 + 0.5 * min(1.0, wide / 0.1))
                fine.append(wide >= margin)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(fine, pa.bool_())], [*names, *new])

    return kept.mapInArrow(run, schema)
