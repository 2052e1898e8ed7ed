"""Article feeds: daily scores, feed caps, consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import clip, safe_div
from tickloom.functions.text import headline_key, is_buy, is_sell, label_from_score
from tickloom.operators.sets import keep_one, top_per_group


def dedupe_headlines(articles: DataFrame, keys: Sequence[str] = ("date", "headline"), order: Sequence[str] = ("article_id",)) -> DataFrame:
    """First article per key; a headline takes part by its digest, so whole texts are not shuffled as keys."""
    return keep_one(articles, [F.sha2("headline", 256) if k == "headline" else k for k in keys], list(order))


def dedupe_prefix(articles: DataFrame, order: Sequence[str] = ("article_id",)) -> DataFrame:
    """One article per day and lower-cased 80-character headline prefix."""
    return keep_one(articles, ["date", headline_key("headline")], list(order))


def _weighted(cond: Column | None = None) -> Column:
    s, w = F.col("score"), F.coalesce(F.col("weight"), F.lit(1.0))
    has = s.isNotNull() if cond is None else s.isNotNull() & cond
    return safe_div(F.sum(F.when(has, s * w)), F.sum(F.when(has, w)))


def daily_scores(articles: DataFrame, providers: Sequence[str], keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Blended and per-provider weighted mean score and article count, all in one aggregate."""
    cols = [_weighted().alias("news_sent_score")]
    cols += [_weighted(F.col("provider") == p).alias(f"news_sent_{p}") for p in providers]
    return articles.groupBy(*keys).agg(*cols, F.count(F.lit(1)).alias("news_articles"))


def capped_feed(articles: DataFrame, per_source: int, total: int) -> DataFrame:
    """Newest first with a cap per provider and a cap in total (the feed's own page sizes)."""
    order = [F.desc("date"), F.desc("article_id")]
    return top_per_group(articles, ["provider"], order, per_source).orderBy(*order).limit(total)


def feed_summary(articles: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean score, label counts and provider counts of a feed."""
    label = label_from_score("score")
    return articles.groupBy(*keys).agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("articles"),
        *[F.count(F.when(label == x, 1)).alias(x) for x in ("positive", "neutral", "negative")],
        F.count_distinct("provider").alias("providers"))


def source_consensus(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Majority label (ties are neutral), its share, and agreement of scores across sources."""
    n = [F.count(F.when(F.col("label") == x, 1)).alias(x) for x in ("positive", "neutral", "negative")]
    g = sources.groupBy(*keys).agg(
        *n, F.count("label").alias("total"), F.avg("score").alias("average_score"),
        F.var_pop("score").alias("variance"), F.count_distinct("label").alias("labels"))
    p, u, m = F.col("positive"), F.col("neutral"), F.col("negative")
    return g.select(
        *keys, "positive", "neutral", "negative", "average_score", "variance",
        F.when((p > m) & (p > u), "positive").when((m > p) & (m > u), "negative").otherwise("neutral").alias("sentiment"),
        safe_div(F.greatest(p, u, m), F.col("total")).alias("confidence"),
        F.when(F.col("variance") < 100, "strong").when(F.col("variance") < 300, "moderate").otherwise("weak").alias("agreement_level"),
        F.when(F.col("labels") == 1, "unanimous").when(F.col("labels") == 2, "mixed").otherwise("divided").alias("sentiment_consensus"))


def insider_monthly(txns: DataFrame) -> DataFrame:
    """Monthly net shares and buy ratio from transaction text; one text may count as both."""
    shares = F.coalesce(F.col("shares"), F.lit(0.0)).cast("decimal(18,2)")
    g = txns.where("date is not null").groupBy("symbol", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum(F.when(is_buy("text"), shares).otherwise(0)).cast("double").alias("bought"),
        F.sum(F.when(is_sell("text"), shares).otherwise(0)).cast("double").alias("sold"))
    return g.withColumns({
        "change": F.col("bought") - F.col("sold"),
        "mspr": F.bround(safe_div("bought", F.col("bought") + F.col("sold")), 4),
    })


def month_start(year: str = "year", month: str = "month") -> Column:
    return F.make_date(F.col(year), F.col(month), F.lit(1))


def insider_summary(monthly: DataFrame, months: int = 3) -> DataFrame:
    """Net change and mean ratio of the latest months with label and 0-100 score."""
    t = top_per_group(monthly, ["symbol"], [F.desc("year"), F.desc("month")], months)
    g = t.groupBy("symbol").agg(F.sum(F.col("change").cast("decimal(18,2)")).cast("double").alias("net_change"), F.avg("mspr").alias("mspr"), F.count(F.lit(1)).alias("months"))
    return g.withColumns({
        "label": label_from_score("mspr", 0.5),
        "score": clip(50 + F.col("mspr") * 50, 0, 100),
    })
