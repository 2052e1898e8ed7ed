"""Landed feeds, statements, insider trades, point-in-time joins, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import dates, text
from tickloom.operators import asof, fundamentals as fund, news as nw, sets
from tickloom.operators.frames import Series
from tickloom.plans import views_sql as v
from tickloom.plans.registry import query, rounded, sql_rounded
from tickloom.sources import feeds, tables as t

KEY = ["symbol", "date"]
S = Series()
PROVIDERS = ["src0", "src1", "src2", "src3"]

# ---- statements ---------------------------------------------------------------------------

_FUND = ["fund_rev_ttm", "fund_gross_profit_ttm", "fund_net_income_ttm", "fund_eps_ttm", "fund_fcf_ttm",
         "fund_gross_margin", "fund_operating_margin", "fund_net_margin", "fund_roe", "fund_roa", "fund_debt_to_equity",
         "fund_current_ratio", "fund_total_assets", "fund_total_debt", "fund_cash", "fund_rev_growth_yoy"]


def _ratio_sql(name: str, src: str, n: int, lag: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""{name}0 AS (SELECT *, sum(total_revenue) {w} AS fund_rev_ttm, sum(gross_profit) {w} AS fund_gross_profit_ttm,
  sum(operating_income) {w} AS op, sum(net_income) {w} AS fund_net_income_ttm, sum(diluted_eps) {w} AS fund_eps_ttm,
  sum(operating_cash_flow) {w} + sum(capital_expenditure) {w} AS fund_fcf_ttm FROM {src}),
{name} AS (SELECT symbol, period_end, fund_rev_ttm, fund_gross_profit_ttm, fund_net_income_ttm, fund_eps_ttm, fund_fcf_ttm,
  {v.sd('fund_gross_profit_ttm', 'fund_rev_ttm')} AS fund_gross_margin, {v.sd('op', 'fund_rev_ttm')} AS fund_operating_margin,
  {v.sd('fund_net_income_ttm', 'fund_rev_ttm')} AS fund_net_margin, {v.sd('fund_net_income_ttm', 'stockholders_equity')} AS fund_roe,
  {v.sd('fund_net_income_ttm', 'total_assets')} AS fund_roa, {v.sd('total_debt', 'stockholders_equity')} AS fund_debt_to_equity,
  {v.sd('current_assets', 'current_liabilities')} AS fund_current_ratio, total_assets AS fund_total_assets,
  total_debt AS fund_total_debt, cash AS fund_cash,
  fund_rev_ttm / lag(fund_rev_ttm, {lag}) OVER (PARTITION BY symbol ORDER BY period_end) - 1 AS fund_rev_growth_yoy,
  strftime(period_end, '%Y-%m-%d') AS fund_quarter_end FROM {name}0)"""


FUND_SQL = f"""{v.STATEMENT}, {_ratio_sql('rq', 'stq', 4, 4)}, {_ratio_sql('ra', 'sta', 1, 1)},
fund AS (SELECT * FROM rq UNION ALL SELECT * FROM ra WHERE (symbol, period_end) NOT IN (SELECT (symbol, period_end) FROM rq))"""


def _fund(spark, d):
    return fund.history(t.statement(spark, d), t.statement(spark, d, "annual"))


@query("fundamental_ratios", "A4 A5 S10 U2", f"""WITH {FUND_SQL}
SELECT {sql_rounded(['symbol', 'period_end', 'fund_quarter_end'], _FUND, 4)} FROM fund""")
def fundamental_ratios(spark, d):
    return rounded(_fund(spark, d), ["symbol", "period_end", "fund_quarter_end"], _FUND, 4)


@query("statement_transpose", "S10 S11", f"""WITH {v.FUND_RAW} SELECT symbol, period_end, revenue, cost, debt,
  coalesce(debt, 0) * 0 + revenue AS picked FROM fraw""")
def statement_transpose(spark, d):
    raw = t.fundamentals_raw(spark, d)
    items = ["revenue", "cost", "debt"]
    lines = raw.unpivot(["symbol", "period_end"], items, "item", "amount")
    wide = fund.transpose_items(lines, items)
    return wide.withColumn("picked", sets.first_existing(wide, "Total Revenue", "revenue"))


@query("fundamentals_asof", "J1", f"""WITH {v.BARS}, {FUND_SQL}
SELECT b.symbol, b.date, round(b.close, 4) AS close, f.fund_quarter_end, round(f.fund_roe, 6) + 0.0 AS fund_roe,
  round(f.fund_rev_ttm, 2) + 0.0 AS fund_rev_ttm
FROM bars b ASOF LEFT JOIN fund f ON b.symbol = f.symbol AND b.date >= f.period_end""")
def fundamentals_asof(spark, d):
    out = asof.asof_join(t.bars_daily(spark, d), _fund(spark, d), ["symbol"], "date", "period_end",
                         ["fund_quarter_end", "fund_roe", "fund_rev_ttm"], bucket_days=365)
    return out.select(*KEY, F.round("close", 4).alias("close"), "fund_quarter_end", F.round("fund_roe", 6).alias("fund_roe"),
                      F.round("fund_rev_ttm", 2).alias("fund_rev_ttm"))


# ---- insider --------------------------------------------------------------------------------

INSIDER_SQL = f"""{v.INSIDER}, mon0 AS (SELECT symbol, year(date) AS year, month(date) AS month,
  CAST(sum(CASE WHEN regexp_matches(lower(text), 'purchase|award|grant') THEN CAST(shares AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS bought,
  CAST(sum(CASE WHEN regexp_matches(lower(text), 'sale|sell') THEN CAST(shares AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS sold
  FROM insider GROUP BY 1, 2, 3),
mon AS (SELECT *, bought - sold AS change, round({v.sd('bought', 'bought + sold')}, 4) AS mspr FROM mon0)"""


@query("insider_monthly", "A3 P10", f"""WITH {INSIDER_SQL}
SELECT symbol, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, round(bought, 2) AS bought, round(sold, 2) AS sold, round(change, 2) + 0.0 AS change, mspr FROM mon""")
def insider_monthly(spark, d):
    m = nw.insider_monthly(t.insider_transactions(spark, d))
    return m.select("symbol", "year", "month", *[F.round(c, 2).alias(c) for c in ("bought", "sold", "change")], "mspr")


@query("insider_asof", "J3", f"""WITH {v.BARS}, {INSIDER_SQL}, m AS (SELECT symbol, make_date(year, month, 1) AS at, change, mspr FROM mon)
SELECT b.symbol, b.date, round(m.change, 2) + 0.0 AS insdr_change, m.mspr AS insdr_mspr
FROM bars b ASOF LEFT JOIN m ON b.symbol = m.symbol AND b.date >= m.at""")
def insider_asof(spark, d):
    m = nw.insider_monthly(t.insider_transactions(spark, d)).select(
        "symbol", nw.month_start().alias("at"), F.round("change", 2).alias("insdr_change"), F.col("mspr").alias("insdr_mspr"))
    return asof.asof_join(t.bars_daily(spark, d).select(*KEY), m, ["symbol"], "date", "at", ["insdr_change", "insdr_mspr"])


@query("insider_summary", "F7 A3", f"""WITH {INSIDER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC, month DESC) AS rk FROM mon),
g AS (SELECT symbol, CAST(sum(CAST(change AS DECIMAL(18,2))) AS DOUBLE) AS net_change, avg(mspr) AS mspr, count(*) AS months FROM r WHERE rk <= 3 GROUP BY 1)
SELECT symbol, net_change, round(mspr, 6) AS mspr, months, CASE WHEN mspr > 0.5 THEN 'positive' WHEN mspr < -0.5 THEN 'negative' ELSE 'neutral' END AS label,
  round(greatest(0, least(100, 50 + mspr * 50)), 4) AS score FROM g""")
def insider_summary(spark, d):
    s = nw.insider_summary(nw.insider_monthly(t.insider_transactions(spark, d)))
    return s.select("symbol", "net_change", F.round("mspr", 6).alias("mspr"), "months", "label", F.round("score", 4).alias("score"))


# ---- news -----------------------------------------------------------------------------------

DEDUPED = "dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, headline ORDER BY article_id) AS rk FROM news) q WHERE rk = 1)"
_W = "CASE WHEN sum(CASE WHEN {c} THEN weight END) <> 0 THEN sum(CASE WHEN {c} THEN score * weight END) / sum(CASE WHEN {c} THEN weight END) END"
DAILY_SQL = f"""{v.NEWS}, {DEDUPED}, daily AS (SELECT symbol, date, {_W.format(c='score IS NOT NULL')} AS news_sent_score,
  {', '.join(_W.format(c=f"score IS NOT NULL AND provider = '{p}'") + f' AS news_sent_{p}' for p in PROVIDERS)},
  count(*) AS news_articles FROM dd GROUP BY 1, 2)"""
_SENT = ["news_sent_score"] + [f"news_sent_{p}" for p in PROVIDERS]


def _daily(spark, d):
    n = t.news(spark, d).select("article_id", *KEY, "provider", "score", "weight", F.sha2("headline", 256).alias("headline"))
    return nw.daily_scores(nw.dedupe_headlines(n), PROVIDERS)


@query("news_daily_scores", "A1 J6 U3", f"WITH {DAILY_SQL} SELECT {sql_rounded(KEY + ['news_articles'], _SENT)} FROM daily")
def news_daily_scores(spark, d):
    return rounded(_daily(spark, d), KEY + ["news_articles"], _SENT)


@query("news_dedupe_prefix", "U4 F6", f"""WITH {v.NEWS}, q AS (SELECT *, row_number() OVER (
  PARTITION BY date, lower(substr(headline, 1, 80)) ORDER BY article_id) AS rk FROM news)
SELECT article_id, symbol, date, provider FROM q WHERE rk = 1""")
def news_dedupe_prefix(spark, d):
    return nw.dedupe_prefix(t.news(spark, d)).select("article_id", "symbol", "date", "provider")


_NEAR = f"""near AS (SELECT b.symbol, b.date, CASE
    WHEN bk.date IS NOT NULL AND b.date - bk.date <= 4 AND (fw.date IS NULL OR b.date - bk.date <= fw.date - b.date) THEN 1
    WHEN fw.date IS NOT NULL AND fw.date - b.date <= 4 THEN 2 END AS side, bk.news_sent_score AS s1, fw.news_sent_score AS s2,
    bk.news_articles AS c1, fw.news_articles AS c2
  FROM bars b ASOF LEFT JOIN daily bk ON b.symbol = bk.symbol AND b.date >= bk.date
  ASOF LEFT JOIN daily fw ON b.symbol = fw.symbol AND b.date <= fw.date),
n0 AS (SELECT symbol, date, CASE side WHEN 1 THEN s1 WHEN 2 THEN s2 END AS s, coalesce(CASE side WHEN 1 THEN c1 WHEN 2 THEN c2 END, 0) AS news_count FROM near),
n1 AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS f FROM n0),
n2 AS (SELECT *, first_value(f IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS news_sent_score FROM n1),
n3 AS (SELECT *, avg(news_sent_score) OVER {v.w(7)} AS news_sent_7d FROM n2)"""


@query("news_nearest_join", "J2 W23 W24", f"""WITH {v.BARS}, {DAILY_SQL}, {_NEAR}
SELECT {sql_rounded(KEY + ['news_count'], ['news_sent_score', 'news_sent_7d'])} FROM n3""")
def news_nearest_join(spark, d):
    from tickloom.operators.matrix import merge_news
    out = merge_news(t.bars_daily(spark, d).select(*KEY), _daily(spark, d), ["news_sent_score"])
    return rounded(out, KEY + ["news_count"], ["news_sent_score", "news_sent_7d"])


@query("news_counts_join", "J5", f"""WITH {v.BARS}, {v.NEWS}, c AS (SELECT symbol, date, count(*) AS n FROM news GROUP BY 1, 2)
SELECT b.symbol, b.date, coalesce(c.n, 0) AS news_count FROM bars b LEFT JOIN c USING (symbol, date)""")
def news_counts_join(spark, d):
    c = t.news(spark, d).groupBy(*KEY).agg(F.count(F.lit(1)).alias("news_count"))
    return t.bars_daily(spark, d).select(*KEY).join(c, KEY, "left").fillna(0, ["news_count"])


@query("news_feed_capped", "O2", f"""WITH {v.NEWS}, q AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY date DESC, article_id DESC) AS rk FROM news)
SELECT article_id, provider, date, headline FROM q WHERE rk <= 8 ORDER BY date DESC, article_id DESC LIMIT 50""")
def news_feed_capped(spark, d):
    return nw.capped_feed(t.news(spark, d), 8, 50).select("article_id", "provider", "date", "headline")


@query("news_latest", "O3 O10", f"""WITH {v.NEWS}, {DEDUPED} SELECT article_id, date, headline,
  CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS label
FROM dd ORDER BY date DESC, article_id DESC LIMIT 100""")
def news_latest(spark, d):
    x = nw.dedupe_headlines(t.news(spark, d)).orderBy(F.desc("date"), F.desc("article_id")).limit(100)
    return x.select("article_id", "date", "headline", text.label_from_score("score").alias("label"))


@query("news_feed_summary", "A24", f"""WITH {v.NEWS} SELECT symbol, round(avg(score), 6) AS mean_score, count(*) AS articles,
  count(CASE WHEN score > 0.05 THEN 1 END) AS positive, count(CASE WHEN score IS NULL OR abs(score) <= 0.05 THEN 1 END) AS neutral,
  count(CASE WHEN score < -0.05 THEN 1 END) AS negative, count(DISTINCT provider) AS providers FROM news GROUP BY 1""")
def news_feed_summary(spark, d):
    return nw.feed_summary(t.news(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


_SRC = f"""src AS (SELECT symbol, provider, (avg(score) + 1) * 50 AS score,
  CASE WHEN avg(score) > 0.15 THEN 'positive' WHEN avg(score) < -0.15 THEN 'negative' ELSE 'neutral' END AS label
  FROM news WHERE score IS NOT NULL GROUP BY 1, 2)"""


@query("source_consensus", "A22 A23 F7", f"""WITH {v.NEWS}, {_SRC}, g AS (SELECT symbol, count(*) FILTER (WHERE label = 'positive') AS positive,
  count(*) FILTER (WHERE label = 'neutral') AS neutral, count(*) FILTER (WHERE label = 'negative') AS negative, count(*) AS total,
  avg(score) AS average_score, var_pop(score) AS variance, count(DISTINCT label) AS labels FROM src GROUP BY 1)
SELECT symbol, positive, neutral, negative, round(average_score, 6) AS average_score, round(variance, 4) AS variance,
  CASE WHEN positive > negative AND positive > neutral THEN 'positive' WHEN negative > positive AND negative > neutral THEN 'negative' ELSE 'neutral' END AS sentiment,
  round(greatest(positive, neutral, negative) * 1.0e0 / total, 6) AS confidence,
  CASE WHEN variance < 100 THEN 'strong' WHEN variance < 300 THEN 'moderate' ELSE 'weak' END AS agreement_level,
  CASE labels WHEN 1 THEN 'unanimous' WHEN 2 THEN 'mixed' ELSE 'divided' END AS sentiment_consensus FROM g""")
def source_consensus(spark, d):
    n = t.news(spark, d).where("score is not null").groupBy("symbol", "provider").agg(F.avg("score").alias("s"))
    n = n.select("symbol", "provider", text.score_0_100("s").alias("score"), text.label_from_score("s", 0.15).alias("label"))
    c = nw.source_consensus(n, ["symbol"])
    return c.withColumns({"average_score": F.round("average_score", 6), "variance": F.round("variance", 4), "confidence": F.round("confidence", 6)})


# ---- landed JSON ----------------------------------------------------------------------------

def landed_bars(spark, d):
    b = t.bars_daily(spark, d)
    r = F.struct((F.unix_date("date").cast("long") * 86400000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                 F.col("close").alias("c"), F.col("volume").alias("v"), ((F.col("high") + F.col("low")) / 2).alias("vw"))
    return b.groupBy("symbol", F.year("date")).agg(F.collect_list(r).alias("results")).select(
        F.to_json(F.struct(F.col("symbol").alias("ticker"), "results")).alias("body"))


@query("landed_bars", "S4 F4", f"WITH {v.BARS} SELECT symbol, date, open, high, low, close, volume, round((high + low) / 2, 4) AS vwap FROM bars")
def landed_bars_query(spark, d):
    return feeds.aggregate_bars(landed_bars(spark, d)).withColumn("vwap", F.round("vwap", 4))


def _body(df, **fields):
    return df.select("article_id", F.to_json(F.struct(*[e.alias(k) for k, e in fields.items()])).alias("body"))


def _ticker(shift: int):
    return F.element_at(F.array(F.lit("a"), F.lit("N"), F.lit("R")), (F.pmod(F.col("article_id") + shift, F.lit(3)) + 1).cast("int"))


def landed_scored(spark, d):
    n = t.news(spark, d)
    item = lambda i: F.struct(_ticker(i).alias("ticker"), (F.pmod(F.col("article_id") + i, F.lit(5)) / 4.0 - 0.5).cast("string").alias("ticker_sentiment_score"),
                              (F.pmod(F.col("article_id") * (i + 1), F.lit(20)) / 20.0).cast("string").alias("relevance_score"))
    at = F.when(F.pmod("article_id", F.lit(17)) == 0, F.lit("bad time")).otherwise(F.concat(F.date_format("date", "yyyyMMdd"), F.lit("T093000")))
    return _body(n, time_published=at, title=F.col("headline"), ticker_sentiment=F.array(item(0), item(1), item(0)))


def _tick_sql(shift: int) -> str:
    return f"CASE (article_id + {shift}) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END"


@query("scored_news_flat", "S5 F4 F10", f"""WITH {v.NEWS} SELECT article_id, symbol, date, headline, score, weight FROM (
  SELECT article_id, {_tick_sql(0)} AS symbol, date, headline, (article_id % 5) / 4.0e0 - 0.5e0 AS score, greatest((article_id % 20) / 20.0e0, 0.1e0) AS weight FROM news WHERE article_id % 17 <> 0
  UNION ALL SELECT article_id, {_tick_sql(1)}, date, headline, ((article_id + 1) % 5) / 4.0e0 - 0.5e0, greatest((article_id * 2 % 20) / 20.0e0, 0.1e0) FROM news WHERE article_id % 17 <> 0) t""")
def scored_news_flat(spark, d):
    return _keep_id(landed_scored(spark, d), feeds.scored_news)


def _keep_id(landed, flatten):
    """Run a flattener with the article id riding inside the title."""
    tagged = landed.withColumn("body", F.regexp_replace("body", r'"title":"', F.concat(F.lit('"title":"'), F.col("article_id").cast("string"), F.lit("|"))))
    out = flatten(tagged.select("body"))
    return out.withColumns({"article_id": F.split_part("headline", F.lit("|"), F.lit(1)).cast("long"),
                            "headline": F.regexp_replace("headline", r"(?s)^\d+\|", "")})


@query("entity_news_flat", "S6", f"""WITH {v.NEWS} SELECT article_id, symbol, date, headline, score, weight FROM (
  SELECT article_id, {_tick_sql(0)} AS symbol, date, headline, score, CASE WHEN article_id % 4 = 0 THEN 1.0e0 ELSE (article_id % 4) * 1.0e0 END AS weight FROM news
  UNION ALL SELECT article_id, {_tick_sql(1)}, date, headline, 0.25e0, 1.0e0 FROM news) t WHERE score IS NOT NULL""")
def entity_news_flat(spark, d):
    n = t.news(spark, d)
    ents = F.array(F.struct(_ticker(0).alias("symbol"), F.col("score").alias("sentiment_score"), F.pmod("article_id", F.lit(4)).cast("double").alias("match_score")),
                   F.struct(_ticker(1).alias("symbol"), F.lit(0.25).alias("sentiment_score"), F.lit(None).cast("double").alias("match_score")))
    return _keep_id(_body(n, published_at=F.date_format("date", "yyyy-MM-dd'T'00:00:00"), title=F.col("headline"), entities=ents), feeds.entity_news)


@query("insight_news_flat", "S7 F10", f"""WITH {v.NEWS}, x AS (SELECT article_id, date, headline, article_id % 4 AS k FROM news)
SELECT article_id, symbol, date, headline, label, score, 1.0e0 AS weight FROM (
  SELECT article_id, date, headline, 'A' AS symbol, CASE k WHEN 0 THEN 'neutral' ELSE 'bullish' END AS label, CASE k WHEN 0 THEN 0.0e0 ELSE 1.0e0 END AS score FROM x
  UNION ALL SELECT article_id, date, headline, 'N', CASE k WHEN 0 THEN 'neutral' WHEN 1 THEN 'bullish' WHEN 2 THEN 'bullish' ELSE 'negative' END,
    CASE k WHEN 0 THEN 0.0e0 WHEN 1 THEN 1.0e0 WHEN 2 THEN 1.0e0 ELSE -1.0e0 END FROM x) t""")
def insight_news_flat(spark, d):
    """k=0 no insights; 1 one; 2 a tie where the first seen wins; 3 a majority of negative."""
    n = t.news(spark, d).withColumn("k", F.pmod("article_id", F.lit(4)))
    one = lambda tk, s: F.struct(F.lit(tk).alias("ticker"), F.lit(s).alias("sentiment"))
    ins = F.when(F.col("k") == 1, F.array(one("a", "Bullish"))).when(F.col("k") == 2, F.array(one("A", "bullish"), one("R", "negative"))).when(
        F.col("k") == 3, F.array(one("A", "bullish"), one("R", "negative"), one("X", "negative")))
    return _keep_id(_body(n, published_utc=F.date_format("date", "yyyy-MM-dd'T'00:00:00'Z'"), title=F.col("headline"),
                          tickers=F.array(F.lit("A"), F.lit("N")), insights=ins), feeds.insight_news)


@query("stream_news_flat", "S8 P14", """SELECT doc_id AS article_id, 'Unknown' AS author, [CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END, 'Z'] AS symbols,
  source AS provider FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 = 1""")
def stream_news_flat(spark, d):
    n = t.news(spark, d)
    kind = F.when(F.pmod("article_id", F.lit(5)) == 0, "subscription").otherwise("n")
    body = n.select(F.to_json(F.struct(kind.alias("T"), F.col("article_id").alias("id"), "headline", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
                                       F.array(F.col("symbol"), F.lit("Z")).alias("symbols"), F.col("provider").alias("source"))).alias("body"))
    return feeds.stream_news(body).where(F.array_contains("symbols", F.upper(F.lit("n")))).select("article_id", "author", "symbols", "provider")


@query("social_posts_flat", "S9", """SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS post_id, coalesce(CASE WHEN role <> 'system' THEN upper(role) END, 'unknown') AS username,
  turn AS likes, CAST(0 AS BIGINT) AS reposts, CASE WHEN turn % 2 = 0 THEN ['A', 'N'] ELSE [] END AS symbols FROM conversations""")
def social_posts_flat(spark, d):
    c = t.table(spark, d, "conversations")
    tags = F.when(F.pmod("turn", F.lit(2)) == 0, F.array(F.struct(F.lit("a").alias("tag")), F.struct(F.lit("n").alias("tag"))))
    posts = c.select(F.to_json(F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), "text", F.col("role").alias("author_id"), F.struct(F.col("turn").alias("like_count")).alias("public_metrics"),
        F.struct(tags.alias("cashtags")).alias("entities"))).alias("body"))
    authors = c.where("role <> 'system'").select(F.col("role").alias("author_id"), F.upper("role").alias("username")).distinct()
    return feeds.social_posts(posts, authors).select("post_id", "username", "likes", "reposts", "symbols")


# ---- sources: fallback, enrichment, incremental ---------------------------------------------

@query("source_fallback", "S12", """WITH a AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date, count(*) AS n, CASE WHEN l_discount > 0.08 THEN 0 ELSE 1 END AS src
  FROM lineitem WHERE l_discount > 0.08 OR l_tax < 0.03 GROUP BY ALL), b AS (SELECT k, min(src) AS src FROM a GROUP BY 1)
SELECT k, date, n FROM a JOIN b USING (k, src)""")
def source_fallback(spark, d):
    li = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("date"), "l_discount", "l_tax")
    one = li.where("l_discount > 0.08").groupBy("k", "date").agg(F.count(F.lit(1)).alias("n"))
    two = li.where("l_discount <= 0.08 and l_tax < 0.03").groupBy("k", "date").agg(F.count(F.lit(1)).alias("n"))
    return sets.first_source([one, two], ["k"])


@query("field_enrichment", "S13", """SELECT o.o_orderkey, coalesce(CASE WHEN o.o_orderkey % 3 <> 0 THEN o.o_totalprice END, l.v) AS value
FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey""")
def field_enrichment(spark, d):
    o = t.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("value"))
    li = t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("value"))
    return sets.fill_from(o, li, ["o_orderkey"], ["value"])


@query("symbol_alias", "S21 P16", """SELECT s_suppkey, coalesce(CASE WHEN n_name IS NOT NULL AND s_nationkey % 5 = 0 THEN s_name || '.TO' END, s_name) AS symbol,
  CASE WHEN s_nationkey % 5 = 0 THEN 'CAD' ELSE 'USD' END AS currency FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def symbol_alias(spark, d):
    """Home listing to local listing by a bounded alias table (nations), currency flag."""
    s = t.table(spark, d, "supplier")
    alias = t.table(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(".TO").alias("suffix"))
    j = s.join(alias, "s_nationkey", "left")
    return j.select("s_suppkey", F.coalesce(F.concat("s_name", "suffix"), F.col("s_name")).alias("symbol"),
                    F.when(F.col("suffix").isNotNull(), "CAD").otherwise("USD").alias("currency"))


@query("instrument_lookup", "P16", """WITH w AS (SELECT s_name AS want FROM supplier UNION ALL SELECT 'missing-' || s_name FROM supplier WHERE s_suppkey % 10 = 0),
hit AS (SELECT want, c_name AS found FROM w JOIN customer ON c_name = replace(want, 'Supplier', 'Customer') AND c_mktsegment IN ('BUILDING', 'MACHINERY')),
alt AS (SELECT w.want, c_name AS found FROM w LEFT JOIN hit USING (want) JOIN customer ON c_name = replace(w.want, 'Supplier', 'Customer') WHERE hit.found IS NULL AND c_mktsegment = 'AUTOMOBILE')
SELECT want, found, 'home' AS listing FROM hit UNION ALL SELECT want, found, 'suffixed' FROM alt""")
def instrument_lookup(spark, d):
    """Exact match on whitelisted exchanges; symbols without one try the second listing."""
    s = t.table(spark, d, "supplier")
    want = s.select(F.col("s_name").alias("want")).union(s.where("s_suppkey % 10 = 0").select(F.concat(F.lit("missing-"), "s_name")))
    want = want.withColumn("c_name", F.expr("replace(want, 'Supplier', 'Customer')"))
    inst = t.table(spark, d, "customer").select("c_name", "c_mktsegment")
    hit = want.join(inst.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), "c_name").select("want", F.col("c_name").alias("found"), F.lit("home").alias("listing"))
    rest = want.join(hit.select("want"), "want", "left_anti")
    alt = rest.join(inst.where("c_mktsegment = 'AUTOMOBILE'"), "c_name").select("want", F.col("c_name").alias("found"), F.lit("suffixed").alias("listing"))
    return hit.unionByName(alt)


@query("incremental_merge", "S16 U1 U2", f"""WITH {v.BARS}, o AS (SELECT symbol, date, close, CAST(NULL AS DOUBLE) AS extra, 0 AS gen FROM bars WHERE date <= DATE '2000-12-31'),
n AS (SELECT symbol, date, close + 1, volume, 1 FROM bars WHERE date > DATE '2000-11-30'),
q AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY gen DESC) AS rk FROM (SELECT * FROM o UNION ALL SELECT * FROM n) t)
SELECT symbol, date, round(close, 4) AS close, extra FROM q WHERE rk = 1""")
def incremental_merge(spark, d):
    from tickloom.operators.matrix import merge_increment
    b = t.bars_daily(spark, d)
    old = b.where("date <= date'2000-12-31'").select(*KEY, "close")
    new = b.where("date > date'2000-11-30'").select(*KEY, (F.col("close") + 1).alias("close"), F.col("volume").alias("extra"))
    return merge_increment(old, new, KEY).select(*KEY, F.round("close", 4).alias("close"), "extra")


@query("source_freshness", "S20", f"""WITH {v.NEWS} SELECT provider, count(*) AS row_count, max(date) AS latest, CASE WHEN count(*) > 0 THEN 'OK' ELSE 'EMPTY' END AS status FROM news GROUP BY 1
UNION ALL SELECT 'unused', 0, NULL, 'EMPTY'""")
def source_freshness(spark, d):
    from tickloom.operators.matrix import source_report
    return source_report({None: t.news(spark, d)}, known=["unused"])


# ---- calendars ------------------------------------------------------------------------------

@query("earnings_distance", "J9 U6", f"""WITH {v.BARS}, {v.REPORTS}, j AS (SELECT b.symbol, b.date, n.event_date AS nx, l.event_date AS ls
  FROM bars b ASOF LEFT JOIN reports n ON b.symbol = n.symbol AND b.date <= n.event_date
  ASOF LEFT JOIN reports l ON b.symbol = l.symbol AND b.date >= l.event_date),
k AS (SELECT symbol, date, CAST(coalesce(nx - date, 9999) AS INTEGER) AS earn_days_to_next, CAST(coalesce(date - ls, 9999) AS INTEGER) AS earn_days_since_last FROM j)
SELECT *, CASE WHEN earn_days_to_next <= 5 OR earn_days_since_last <= 5 THEN 1 ELSE 0 END AS earn_is_week FROM k""")
def earnings_distance(spark, d):
    return asof.event_distance(t.bars_daily(spark, d).select(*KEY), t.report_dates(spark, d), ["symbol"], "date", "event_date")


@query("event_calendar", "U5 P15 F3", f"""WITH {v.REPORTS}, {v.FUND_RAW} SELECT * FROM (
  SELECT symbol, event_date AS date, 'earnings' AS type, 'high' AS importance FROM reports
  UNION ALL SELECT symbol, period_end, 'dividend', 'medium' FROM fraw
  UNION ALL SELECT DISTINCT CAST(NULL AS VARCHAR), CAST(date_trunc('month', o_orderdate) AS DATE), 'macro', 'high' FROM orders) t
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def event_calendar(spark, d):
    e = t.report_dates(spark, d).select("symbol", F.col("event_date").alias("date"), F.lit("earnings").alias("type"), F.lit("high").alias("importance"))
    v_ = t.fundamentals_raw(spark, d).select("symbol", F.col("period_end").alias("date"), F.lit("dividend").alias("type"), F.lit("medium").alias("importance"))
    m = t.table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("date")).distinct().select(
        F.lit(None).cast("string").alias("symbol"), "date", F.lit("macro").alias("type"), F.lit("high").alias("importance"))
    return sets.union_aligned(e, v_, m).where(F.col("date").between("1996-01-01", "1998-12-31"))


@query("session_calendar", "F5 F3", """WITH b AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS z FROM events),
days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT d.date, count(e.event_id) AS ticks, count(CASE WHEN (hour(ts) * 60 + minute(ts) - 300) BETWEEN 570 AND 959 THEN 1 END) AS session_ticks
FROM days d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.date WHERE isodow(d.date) <= 5 GROUP BY 1""")
def session_calendar(spark, d):
    """Business days of the tick range with ticks inside the New York session (winter, UTC-5)."""
    ev = t.ticks(spark, d)
    lo, hi = ev.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    days = dates.weekday_calendar(spark, str(lo), str(hi))
    per = ev.groupBy(F.to_date("ts").alias("date")).agg(
        F.count("event_id").alias("ticks"), F.count(F.when(dates.market_open(F.col("ts").cast("timestamp")), 1)).alias("session_ticks"))
    return days.join(per, "date", "left").fillna(0)


@query("display_text", "F9 F6", """SELECT p_partkey, '$' || CASE WHEN v >= 1e9 THEN printf('%.2fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.2fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.2fK', v / 1e3)
  ELSE printf('%.0f', v) END AS money, printf('%.1f%%', CASE WHEN r < 1 THEN r * 100 ELSE r END) AS pct, printf('%.1f', r) AS ratio
FROM (SELECT p_partkey, p_retailprice * pow(10, p_partkey % 8) + 0.001e0 AS v, (p_partkey % 30) / 7.0e0 AS r FROM part) t""")
def display_text(spark, d):
    p = t.table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * F.pow(F.lit(10.0), F.col("p_partkey") % 8) + 0.001).alias("v"), ((F.col("p_partkey") % 30) / 7.0).alias("r"))
    return p.select("p_partkey", text.money_text("v").alias("money"), text.percent_text("r").alias("pct"), text.ratio_text("r").alias("ratio"))


@query("json_props", "F10", """SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total, count(*) AS n FROM events GROUP BY 1""")
def json_props(spark, d):
    j = F.from_json("props", "k bigint")["k"]
    return t.table(spark, d, "events").groupBy("event_type").agg(F.sum(j).alias("total"), F.count(F.lit(1)).alias("n"))
