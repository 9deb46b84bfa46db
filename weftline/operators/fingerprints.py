"""Texts that are the same, as they stand or once case, accents and all but words are put aside."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.folders import cut


def _folds() -> tuple[str, str]:
    """Letters that are a basic letter with marks, from U+00C0 to U+024F and U+1E00 to U+1EFF, and their basic letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(code))
        letters = [c for c in base if not unicodedata.combining(c)]
        if len(base) > 1 and len(letters) == 1 and letters[0].isascii() and letters[0].isalpha():
            pairs.append((chr(code), letters[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Made by rule: what translate() turns into what.
MARKED, PLAIN = _folds()
#: Marks that stand for themselves, and what is no letter, digit or character beyond ASCII.
MARKS, GAPS = r"[\x{0300}-\x{036F}]+", r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def folded(text: Column) -> Column:
    """The words of a text with single blanks: full-width forms and accented Latin letters as basic ones, in lower case."""
    wide = "".join(chr(0xFF01 + k) for k in range(94))
    narrow = "".join(chr(0x21 + k) for k in range(94))
    basic = F.lower(F.translate(text, MARKED + wide, PLAIN + narrow))
    return F.btrim(F.regexp_replace(F.regexp_replace(basic, MARKS, ""), GAPS, " "), F.lit(" "))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_md5, exact_id, words_md5, class_id, n_same: the first document with the same text and with the same words.

    Digests are counted in the tasks first and go back to the documents by joins of digests, in which Spark
    splits what many documents share; no text is moved. Texts without words are the same only if they
    are alike. A null text is of no class and has n_same 0; repeated rows count each; documents without an
    id count, but are no class's first.
    """
    text = F.col(text_col)
    words = folded(text)
    words_md5 = F.md5(F.when(words != "", words).otherwise(F.concat(F.lit("\x01"), text)))
    # kept, so that each text is folded once
    made = cut(docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("text_md5"), words_md5.alias("words_md5")))
    exact = made.where("text_md5 is not null").groupBy(F.col("text_md5").alias("e")).agg(F.min("doc_id").alias("exact_id"))
    same = made.where("words_md5 is not null").groupBy(F.col("words_md5").alias("w")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_same"))
    both = made.join(exact, F.col("text_md5") == F.col("e"), "left").join(same, F.col("words_md5") == F.col("w"), "left")
    return both.select("doc_id", "text_md5", "exact_id", "words_md5", "class_id", F.coalesce("n_same", F.lit(0)).alias("n_same"))
