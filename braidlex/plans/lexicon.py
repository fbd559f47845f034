"""Texts analysed with a lexicon of any size.

A short lexicon is a list in the plan. A longer one is a table: the distinct
words of each text are joined to it, and come back as one array a text. What
decides is a count, of the lexicon and then of the corpus' words that are in
it: many long lexicons meet a corpus in few words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlex.functions.lang import LanguagePair, dealt, tokens
from braidlex.operators import analysis as A
from braidlex.plans.ranks import joined_to
from braidlex.plans.tables import cut

#: Words that are matched by a list in the plan.
LISTED = 100_000


def listed(words: DataFrame, limit: int) -> tuple[str, ...] | None:
    """The words, where they are ``limit`` at most."""
    found = [r.word for r in words.limit(limit + 1).collect()]  # checked: one more than the list may have
    return tuple(sorted(found)) if len(found) <= limit else None


def analyze(df: DataFrame, pair: LanguagePair, words: DataFrame, text: str = "text", limit: int = LISTED) -> DataFrame:
    """``analysis.analyze`` with the lexicon ``words`` (a column word; lower-cased here, repeats and nulls dropped)."""
    lexicon = cut(words.select(F.lower("word").alias("word")).filter("word is not null").distinct(), "lexicon")
    outside = pair.replaced(lexicon=(), outside=True)
    known = listed(lexicon, limit)
    if known:
        return A.analyze(df, pair.replaced(lexicon=known))
    rows = cut(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    low = F.array_distinct(F.transform(tokens(F.col(text), outside), F.lower))
    own = rows.select("__row", F.explode(low).alias("word"))
    met = cut(own.groupBy("word").agg(F.count(F.lit(1)).alias("__n")).join(lexicon, "word", "left_semi"), "met")
    known = listed(met.select("word"), limit)
    if known:
        return A.analyze(rows.drop("__row"), pair.replaced(lexicon=known))
    of_row = joined_to(own, met, "word").groupBy("__row").agg(F.collect_list("word").alias("__listed")).select("__row", dealt(F.col("__listed")).alias("__words"))
    whole = rows.join(of_row, "__row", "left")  # null where a text has none of the words
    return A.analyze(whole, outside, text, "__words").drop("__row", "__words")
