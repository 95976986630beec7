"""Inverted index of trigrams over text columns, and search by containment."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of every script that carry marks of their own, with the letter under them: taken from the decompositions of Unicode.
ACCENTED = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0x80, 0x3000) if len(unicodedata.normalize("NFD", chr(i))) > 1 and unicodedata.combining(unicodedata.normalize("NFD", chr(i))[1])]


def plain(text: Column) -> Column:
    """Lower case without marks on the letters, whether they are part of a letter or follow it."""
    low = {a: b for a, b in ACCENTED if a == a.lower()}
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), "".join(low), "".join(low.values()))


#: Three characters from each one on; no match begins within a character that takes two units.
EACH = r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"


def trigrams(text: Column) -> Column:
    """Different trigrams of a text; none of a null or of less than three characters. One pass over the text, whatever its length."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(EACH), F.lit(1))))


def trigram_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """trigram, key: one row for each trigram of each row's text; repeated rows count once."""
    return df.select(F.explode(trigrams(plain(F.col(text)))).alias("trigram"), key).distinct()


def trigram_search(index: DataFrame, key: str, *patterns: str) -> DataFrame:
    """Keys that have every trigram of all patterns; patterns shorter than three characters have none and match nothing."""
    wanted = index.sparkSession.createDataFrame([(p,) for p in patterns], "p string").select(F.explode(trigrams(plain(F.col("p")))).alias("t")).distinct()
    n = wanted.count()
    if not n:
        return index.select(key).limit(0)
    return index.join(F.broadcast(wanted), F.col("trigram") == F.col("t")).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select(key)  # patterns are typed by hand


def label_search(df: DataFrame, column: str, *patterns: str) -> DataFrame:
    """Rows whose label contains any pattern, whatever its case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.lower(F.col(column)).contains(p.lower())
    return df.where(hit)
