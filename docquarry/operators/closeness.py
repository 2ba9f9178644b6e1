"""Close matches of a word by an index of characters, exact for the ratio of matching blocks.

The ratio of two words is twice the characters in matching blocks over the characters of both.
A gram is a character with its number of occurrence in a word, so two words share as many grams
as characters if order is left out: a bound for the blocks. A word within the cutoff must have
a length in a range and share a least number of grams, hence one of the query's rarest ones,
all but that number. Only the postings of these are read, by gram and length; what they name is
counted against the bound in columns, and only what passes is compared in Python.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans.registry import query
from docquarry.sources import corpus
from docquarry.sources.shared import kept

CUTOFF = 0.6
_OCC = f"WITH {corpus.SQL}"


def grams_of(word: str) -> list[str]:
    """Each character with its number of occurrence, in order."""
    seen: Counter = Counter()
    out = []
    for c in word:
        seen[c] += 1
        out.append(f"{c}{seen[c]}")
    return out


def char_index(words: DataFrame) -> DataFrame:
    """gram, length and word for each gram of each of the distinct ``words``."""
    chars = F.split("word", "")
    letters = F.filter(chars, lambda c: c != "")
    numbered = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda d: d == c)).cast("string")))
    return words.where(F.length("word") > 0).select(F.explode(numbered).alias("gram"), F.length("word").alias("length"), "word")


def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all words of the corpus, in the order of grams and lengths."""

    def build() -> DataFrame:
        own = char_index(corpus.words(spark, sf_dir).select("word").distinct())
        return own.repartitionByRange("gram", "length", "word").sortWithinPartitions("gram", "length")

    return kept(spark, sf_dir, "char_index", build)


def lengths(n: int, cutoff: float) -> tuple[int, int]:
    """Least and greatest length of a word whose ratio with one of ``n`` characters can reach the cutoff."""
    return math.ceil(round(cutoff / (2 - cutoff) * n, 9)), math.floor(round((2 - cutoff) / cutoff * n, 9))


def candidates(index: DataFrame, wanted: str, cutoff: float = CUTOFF) -> DataFrame:
    """Words that share enough grams with ``wanted``; no word within the cutoff is missing."""
    grams, (low, high) = grams_of(wanted), lengths(len(wanted), cutoff)
    asked = index.where(F.col("gram").isin(grams) & F.col("length").between(low, high))
    often = {r.gram: r["count"] for r in asked.groupBy("gram").count().collect()}  # as many as characters
    least = max(1, math.ceil(round(cutoff * (len(wanted) + low) / 2, 9)))
    rare = sorted(grams, key=lambda g: (often.get(g, 0), g))[: len(grams) - least + 1]
    found = asked.where(F.col("gram").isin(rare)).select("word").distinct()
    shared = F.lit(0)
    for char, n in sorted(Counter(wanted).items()):
        shared = shared + F.least(F.length("word") - F.length(F.replace("word", F.lit(char), F.lit(""))), F.lit(n))
    return found.where(2.0 * shared >= F.lit(cutoff) * (F.length("word") + len(wanted)) - 1e-9)


def close_matches(index: DataFrame, wanted: str, cutoff: float = CUTOFF) -> DataFrame:
    """word and ratio of all indexed words whose ratio with ``wanted`` reaches the cutoff."""

    @F.pandas_udf("double")
    def ratio(word: pd.Series) -> pd.Series:
        match = difflib.SequenceMatcher(None, b=wanted)
        out = []
        for w in word:
            match.set_seq1(w)
            out.append(match.ratio())
        return pd.Series(out, dtype="float64")

    if not wanted:
        return index.select("word", F.lit(0.0).alias("ratio")).limit(0)
    return candidates(index, wanted, cutoff).select("word", ratio("word").alias("ratio")).where(F.col("ratio") >= cutoff)


def complete(counted: DataFrame, index: DataFrame, wanted: str, limit: int, cutoff: float = CUTOFF) -> DataFrame:
    """suggestion, kind and n: words that begin with ``wanted``, most frequent first, then, where
    these are fewer than ``limit``, the closest other words.

    ``counted``: word and n. The fill is part of the plan and ranked by itself, so nothing is
    asked of the driver in between.
    """
    own = counted.where(F.col("word").startswith(wanted)).orderBy(F.desc("n"), "word").limit(limit).select(F.col("word").alias("suggestion"), F.lit("word").alias("kind"), "n", F.lit(0.0).alias("ratio"))
    close = close_matches(index, wanted, cutoff).where(~F.col("word").startswith(wanted)).orderBy(F.desc("ratio"), "word").limit(limit)
    both = own.unionByName(close.select(F.col("word").alias("suggestion"), F.lit("fuzzy_match").alias("kind"), F.lit(0).cast("long").alias("n"), "ratio"))
    return both.orderBy(F.desc(F.col("kind") == "word"), F.desc("n"), F.desc("ratio"), "suggestion").limit(limit).select("suggestion", "kind", "n")


def _overlap_sql(wanted: str) -> str:
    return " + ".join(f"least(length(word) - length(replace(word, '{c}', '')), {n})" for c, n in sorted(Counter(wanted).items()))


def _bound(wanted: str, cutoff: float) -> str:
    return f"2.0 * ({_overlap_sql(wanted)}) >= {cutoff} * (length(word) + {len(wanted)}) - 1e-9"


@query()
def fuzzy_close_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty words most like a misspelt one."""
    return close_matches(word_index(spark, sf_dir), "licence").orderBy(F.desc("ratio"), "word").limit(20)


@query(f"{_OCC} SELECT DISTINCT word FROM words WHERE {_bound('licence', CUTOFF)}")
def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the index leaves to be compared: all with enough characters in common."""
    return candidates(word_index(spark, sf_dir), "licence")


@query()
def autocomplete_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of a word that few words begin with, filled up with close ones."""
    counted = corpus.words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    return complete(counted, word_index(spark, sf_dir), "licens", 10)

