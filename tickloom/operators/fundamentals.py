"""Company statements to trailing metrics, ratios and growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import safe_div
from tickloom.operators.frames import Series
from tickloom.operators.sets import keep_one

PERIODS = Series(("symbol",), ("period_end",))


def transpose_items(lines: DataFrame, items: Sequence[str]) -> DataFrame:
    """Long statement lines (symbol, period_end, item, amount) to one row per period."""
    return lines.groupBy("symbol", "period_end").pivot("item", list(items)).agg(F.first("amount"))


def ratio_suite(statement: DataFrame, ttm: int, growth_lag: int, s: Series = PERIODS) -> DataFrame:
    """Trailing sums over ``ttm`` periods (nulls skipped) and the ratios built on them."""
    def trail(c: str):
        return F.sum(c).over(s.back(ttm))

    df = statement.withColumns({
        "fund_rev_ttm": trail("total_revenue"), "fund_gross_profit_ttm": trail("gross_profit"),
        "_op": trail("operating_income"), "fund_net_income_ttm": trail("net_income"),
        "fund_eps_ttm": trail("diluted_eps"),
        "fund_fcf_ttm": trail("operating_cash_flow") + trail("capital_expenditure"),
    })
    df = df.withColumns({
        "fund_gross_margin": safe_div("fund_gross_profit_ttm", "fund_rev_ttm"),
        "fund_operating_margin": safe_div("_op", "fund_rev_ttm"),
        "fund_net_margin": safe_div("fund_net_income_ttm", "fund_rev_ttm"),
        "fund_roe": safe_div("fund_net_income_ttm", "stockholders_equity"),
        "fund_roa": safe_div("fund_net_income_ttm", "total_assets"),
        "fund_debt_to_equity": safe_div("total_debt", "stockholders_equity"),
        "fund_current_ratio": safe_div("current_assets", "current_liabilities"),
        "fund_rev_growth_yoy": safe_div("fund_rev_ttm", s.lag("fund_rev_ttm", growth_lag)) - 1,
    })
    return df.select(
        "symbol", "period_end", "fund_rev_ttm", "fund_gross_profit_ttm", "fund_net_income_ttm", "fund_eps_ttm",
        "fund_fcf_ttm", "fund_gross_margin", "fund_operating_margin", "fund_net_margin", "fund_roe", "fund_roa",
        "fund_debt_to_equity", "fund_current_ratio", F.col("total_assets").alias("fund_total_assets"),
        F.col("total_debt").alias("fund_total_debt"), F.col("cash").alias("fund_cash"), "fund_rev_growth_yoy",
        F.date_format("period_end", "yyyy-MM-dd").alias("fund_quarter_end"))


def history(quarterly: DataFrame, annual: DataFrame) -> DataFrame:
    """Both tiers; a quarterly row wins over an annual row of the same date."""
    both = ratio_suite(annual, 1, 1).withColumn("_tier", F.lit(0)).unionByName(
        ratio_suite(quarterly, 4, 4).withColumn("_tier", F.lit(1)))
    return keep_one(both, ["symbol", "period_end"], ["_tier"], last=True).drop("_tier")
