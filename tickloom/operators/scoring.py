"""Text scoring by word lists as a column, or by any scorer loaded once per Python worker and fed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default scorer's word lists.
POSITIVE_WORDS = ("gain", "gains", "rise", "profit", "strong", "growth", "beat", "record", "good", "new")
NEGATIVE_WORDS = ("loss", "losses", "fall", "weak", "debt", "miss", "risk", "lawsuit", "bad", "error")

PROBS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("positive", "negative", "neutral")])


def word_probabilities(text: str | Column) -> Column:
    """Struct of class shares from word counts over the whole text, with one neutral count added; null counts as empty."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit("[a-z]+"), 0)
    p, n = F.size(F.filter(words, lambda w: w.isin(*POSITIVE_WORDS))), F.size(F.filter(words, lambda w: w.isin(*NEGATIVE_WORDS)))
    total = (p + n + 1).cast("double")
    return F.struct((p / total).alias("positive"), (n / total).alias("negative"), (1 / total).alias("neutral"))


def text_probabilities(text: str | Column, load: Callable) -> Column:
    """Struct of class probabilities by a caller's model. ``load`` runs once per worker and returns a batch scorer."""

    @F.pandas_udf(PROBS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for s in batches:
            yield pd.DataFrame(scorer(s.tolist()), columns=["positive", "negative", "neutral"])

    return run(text)


def daily_probabilities(articles: DataFrame, keys: Sequence[str] = ("symbol", "date"), load: Callable | None = None) -> DataFrame:
    """Mean class probabilities, mean signed score and article count per day."""
    p = word_probabilities("text") if load is None else text_probabilities(F.col("text"), load)
    s = articles.withColumn("_p", p).select(*keys, "_p.*")
    return s.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("positive", "negative", "neutral")],
                                F.avg(F.col("positive") - F.col("negative")).alias("score"), F.count(F.lit(1)).alias("articles"))
