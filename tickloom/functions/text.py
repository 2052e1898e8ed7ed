"""Labels, score maps and display text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numeric import col

# Score of each sentiment word.
LABEL_SCORES = {"positive": 1.0, "negative": -1.0, "neutral": 0.0, "bullish": 1.0, "bearish": -1.0}
BUY_WORDS = r"purchase|award|grant"
SELL_WORDS = r"sale|sell"


def label_from_score(score, cut: float = 0.05) -> Column:
    s = col(score)
    return F.when(s > cut, "positive").when(s < -cut, "negative").otherwise("neutral")


def score_from_label(label) -> Column:
    pairs = [F.lit(x) for kv in LABEL_SCORES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(col(label))), F.lit(0.0))


def score_0_100(score) -> Column:
    """A -1..1 score on a 0..100 scale."""
    return (col(score) + 1) * 50


def is_buy(text) -> Column:
    return F.lower(F.coalesce(col(text), F.lit(""))).rlike(BUY_WORDS)


def is_sell(text) -> Column:
    return F.lower(F.coalesce(col(text), F.lit(""))).rlike(SELL_WORDS)


def headline_key(headline, n: int = 80) -> Column:
    return F.lower(F.substring(col(headline), 1, n))


NO_VALUE = "\u2014"


def _scaled(x: Column, prefix: str, suffix: str, plain: Column) -> Column:
    size = F.abs(x)

    def unit(scale: float, mark: str) -> Column:
        return F.format_string(f"{prefix}%.2f{mark}{suffix}", x / scale)

    return (
        F.when(x.isNull(), NO_VALUE).when(size >= 1e9, unit(1e9, "B")).when(size >= 1e6, unit(1e6, "M"))
        .when(size >= 1e3, unit(1e3, "K")).otherwise(plain))


def money_text(x) -> Column:
    """$1.23B / M / K with two decimals, whole dollars below a thousand."""
    x = col(x)
    return _scaled(x, "$", "", F.format_string("$%,.0f", x))


def percent_text(x, decimals: int = 1) -> Column:
    """Percent text; values below 1 are taken as fractions."""
    x = col(x)
    v = F.when(x < 1, x * 100).otherwise(x)
    return F.when(x.isNull(), NO_VALUE).otherwise(F.format_string(f"%.{decimals}f%%", v))


def ratio_text(x, decimals: int = 1) -> Column:
    x = col(x)
    return F.when(x.isNull(), NO_VALUE).otherwise(F.format_string(f"%.{decimals}f", x))
