"""Flatten landed provider JSON (one document per row, text column ``body``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import none_if_zero
from tickloom.functions.text import score_from_label

BARS_SCHEMA = "ticker string, results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double, vw: double>>"
SCORED_SCHEMA = ("time_published string, title string, ticker_sentiment array<struct<ticker: string, "
                 "ticker_sentiment_score: string, relevance_score: string>>")
ENTITY_SCHEMA = ("published_at string, title string, entities array<struct<symbol: string, "
                 "sentiment_score: double, match_score: double>>")
INSIGHT_SCHEMA = "published_utc string, title string, tickers array<string>, insights array<struct<ticker: string, sentiment: string>>"
STREAM_SCHEMA = "T string, id bigint, headline string, summary string, author string, created_at string, url string, symbols array<string>, source string"
POST_SCHEMA = ("id string, text string, author_id string, created_at string, public_metrics struct<like_count: bigint, "
               "retweet_count: bigint, reply_count: bigint>, entities struct<cashtags: array<struct<tag: string>>>")


def parse(df: DataFrame, schema: str, body: str = "body") -> DataFrame:
    return df.withColumn("_j", F.from_json(body, schema)).select(*[c for c in df.columns if c != body], "_j.*")


def aggregate_bars(df: DataFrame) -> DataFrame:
    """Short-named aggregate bars: epoch milliseconds to day, long column names."""
    b = parse(df, BARS_SCHEMA).select("ticker", F.explode("results").alias("b"))
    return b.select(
        F.col("ticker").alias("symbol"), F.to_date(F.timestamp_millis("b.t")).alias("date"), F.col("b.o").alias("open"),
        F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"),
        F.col("b.vw").alias("vwap"))


def _first_per_ticker(items: Column, field: str) -> Column:
    names = F.array_distinct(F.transform(items, lambda x: F.upper(x[field])))
    return F.transform(names, lambda t: F.element_at(F.filter(items, lambda x: F.upper(x[field]) == t), 1))


def scored_news(df: DataFrame) -> DataFrame:
    """The first entry of each ticker in an article; relevance is at least 0.1."""
    a = parse(df, SCORED_SCHEMA)
    when = F.try_to_timestamp("time_published", F.lit("yyyyMMdd'T'HHmmss"))
    a = a.withColumns({"_at": when, "_e": F.explode(_first_per_ticker(F.col("ticker_sentiment"), "ticker"))})
    return a.where("_at is not null").select(
        F.upper("_e.ticker").alias("symbol"), F.to_date("_at").alias("date"), F.col("title").alias("headline"),
        F.coalesce(F.col("_e.ticker_sentiment_score").cast("double"), F.lit(0.0)).alias("score"),
        F.greatest(F.coalesce(F.col("_e.relevance_score").cast("double"), F.lit(0.5)), F.lit(0.1)).alias("weight"))


def entity_news(df: DataFrame) -> DataFrame:
    """Every entity with a score; a zero or missing match score weighs 1."""
    a = parse(df, ENTITY_SCHEMA).withColumn("_e", F.explode("entities"))
    return a.where((F.coalesce("published_at", F.lit("")) != "") & F.col("_e.sentiment_score").isNotNull()).select(
        F.upper("_e.symbol").alias("symbol"), F.to_date(F.substring("published_at", 1, 10)).alias("date"),
        F.col("title").alias("headline"), F.col("_e.sentiment_score").alias("score"),
        F.coalesce(none_if_zero(F.col("_e.match_score")), F.lit(1.0)).alias("weight"))


def most_common(labels: Column) -> Column:
    """Most frequent value of an array; the first seen wins a tie."""
    counted = F.transform(F.array_distinct(labels), lambda t: F.struct(
        F.size(F.filter(labels, lambda x: x == t)).alias("n"), (-F.array_position(labels, t)).alias("p"), t.alias("label")))
    return F.array_max(counted)["label"]


def insight_news(df: DataFrame) -> DataFrame:
    """Per mentioned ticker: its own insight, else the article's most common one, else neutral."""
    a = parse(df, INSIGHT_SCHEMA).withColumn("_t", F.explode("tickers"))
    labels = F.transform(F.coalesce("insights", F.array()), lambda i: F.lower(F.coalesce(i["sentiment"], F.lit("neutral"))))
    a = a.withColumn("_labels", labels)
    mine = F.filter("insights", lambda i: F.upper(i["ticker"]) == F.upper(F.col("_t")))
    own = F.when(F.size(mine) > 0, F.lower(F.coalesce(F.get(mine, 0)["sentiment"], F.lit("neutral"))))
    a = a.withColumn("label", F.coalesce(own, most_common(F.col("_labels")), F.lit("neutral")))
    return a.select(
        F.upper("_t").alias("symbol"), F.to_date(F.substring("published_utc", 1, 10)).alias("date"),
        F.col("title").alias("headline"), "label", score_from_label("label").alias("score"), F.lit(1.0).alias("weight"))


def stream_news(df: DataFrame) -> DataFrame:
    """Messages of type n in the standard record; works on batch and streaming frames."""
    return parse(df, STREAM_SCHEMA).where("T = 'n'").select(
        F.col("id").alias("article_id"), "headline", F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("author", F.lit("Unknown")).alias("author"), F.to_timestamp("created_at").alias("created_at"),
        "url", F.coalesce("symbols", F.array()).alias("symbols"), F.coalesce("source", F.lit("stream")).alias("provider"))


def social_posts(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Posts with author names, metrics and the symbols of their cashtags."""
    p = parse(posts, POST_SCHEMA)
    j = p.join(authors, "author_id", "left")
    return j.select(
        F.col("id").alias("post_id"), "text", F.coalesce("username", F.lit("unknown")).alias("username"), "created_at",
        F.coalesce("public_metrics.like_count", F.lit(0)).alias("likes"),
        F.coalesce("public_metrics.retweet_count", F.lit(0)).alias("reposts"),
        F.transform(F.coalesce("entities.cashtags", F.array()), lambda x: F.upper(x["tag"])).alias("symbols"))
