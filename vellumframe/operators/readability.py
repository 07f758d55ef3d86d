"""Document statistics, readability scores and reading times; projections only, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def doc_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds words, chars, chars_no_space, sentences, syllables, complex_words and their averages.

    A text without words has zero sentences; null and blank texts have zeros everywhere.
    """
    clean = F.trim(F.coalesce(F.col(text), F.lit("")))
    df = docs.withColumn("_clean", clean).withColumn("_syl", F.transform(F.transform(T.words(F.col("_clean")), lambda w: T.bare(w, plain=True)), T.bare_syllables))
    df = df.withColumn("words", F.size("_syl").cast("long"))
    some = F.col("words") > 0
    df = df.withColumn("chars", F.length("_clean").cast("long")).withColumn("chars_no_space", F.length(F.regexp_replace("_clean", r"\s+", "")).cast("long"))
    df = df.withColumn("sentences", F.when(some, F.greatest(F.lit(1), T.sentence_count(F.col("_clean")))).otherwise(0).cast("long"))
    df = df.withColumn("syllables", F.aggregate("_syl", F.lit(0).cast("long"), lambda a, x: a + x))
    df = df.withColumn("complex_words", F.size(F.filter("_syl", lambda x: x >= 3)).cast("long"))
    df = df.withColumn("words_per_sentence", F.when(some, T.rounded(F.col("words") / F.greatest(F.lit(1), F.col("sentences")), 1)).otherwise(0.0))
    df = df.withColumn("syllables_per_word", F.when(some, T.rounded(F.col("syllables") / F.greatest(F.lit(1), F.col("words")), 2)).otherwise(0.0))
    return df.drop("_clean", "_syl")


def complexity_band(ease: Column, grade: Column) -> Column:
    """easy from 80; moderate from 60 or for grades 7 to 10; else dense."""
    return F.when(ease >= 80, "easy").when((ease >= 60) | grade.between(7, 10), "moderate").otherwise("dense")


def readability_scores(stats: DataFrame) -> DataFrame:
    """Adds reading_ease, grade_level, fog_index and band to rows of doc_statistics."""
    n, s = F.greatest(F.lit(1), F.col("words")), F.greatest(F.lit(1), F.col("sentences"))
    ease = T.rounded(206.835 - 1.015 * (n / s) - 84.6 * (F.col("syllables") / n), 1)
    grade = F.greatest(F.lit(0.0), T.rounded(0.39 * (n / s) + 11.8 * (F.col("syllables") / n) - 15.59, 1))
    fog = F.greatest(F.lit(0.0), T.rounded(0.4 * (n / s + 100 * (F.col("complex_words") / n)), 1))
    none = F.col("words") == 0
    out = stats.withColumn("reading_ease", F.when(none, 100.0).otherwise(ease)).withColumn("grade_level", F.when(none, 0.0).otherwise(grade)).withColumn("fog_index", F.when(none, 0.0).otherwise(fog))
    return out.withColumn("band", complexity_band(F.col("reading_ease"), F.col("grade_level")))


def reading_times(stats: DataFrame, silent: int = 200, aloud: int = 130) -> DataFrame:
    """Adds silent and aloud minutes (2 places) and whole seconds for a word count."""
    out = stats
    for name, pace in (("silent", silent), ("aloud", aloud)):
        out = out.withColumn(f"{name}_minutes", T.rounded(F.col("words") / pace, 2)).withColumn(f"{name}_seconds", T.rounded(F.col("words") / pace * 60).cast("long"))
    return out


def doc_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds word_count, char_count, reading_minutes, is_reliable and n_paragraphs (lines of over 60 characters)."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    df = docs.withColumn("_lines", lines)
    df = df.withColumn("word_count", F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + F.size(T.spaced_words(x))))
    df = df.withColumn("char_count", F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    df = df.withColumn("reading_minutes", F.greatest(F.lit(1), F.ceil(F.col("word_count") / 200)).cast("long")).withColumn("is_reliable", F.col("word_count") >= 25)
    return df.withColumn("n_paragraphs", F.size(F.filter("_lines", lambda x: F.length(x) > 60)).cast("long")).drop("_lines")
