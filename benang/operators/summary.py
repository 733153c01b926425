"""Summaries for whole sets and groups, and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("positif", "negatif", "netral")


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def label_summary(df: DataFrame, group: str | None = None, label: str = "sentiment", retweet: str = "is_retweet", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Totals, retweets, originals, counts and shares per label: for all rows ('*') and, with ``group``, per group,
    in one pass."""
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col(retweet), F.lit(False))).alias("retweets")] + [F.count_if(F.col(label) == x).alias(f"n_{x}") for x in labels]
    if group:
        out = df.groupingSets([[], [group]], group).agg(F.when(F.grouping(group) == 1, "*").otherwise(F.coalesce(F.col(group), F.lit(""))).alias("summary"), *aggs).drop(group)
    else:
        out = df.agg(F.lit("*").alias("summary"), *aggs)
    return out.withColumns({"originals": F.col("total") - F.col("retweets")} | {f"pct_{x}": percent(F.col(f"n_{x}"), F.col("total")) for x in labels})


def top(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values; of equals the least."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def tail(df: DataFrame, order: list[str], k: int = 200) -> DataFrame:
    """The last k rows of an order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)


def ordered_distinct(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Values distinct apart from case, the first spelling kept, with where it stood."""
    key = F.lower(F.trim(column))
    first = df.where(F.trim(column) != "").groupBy(key.alias("key")).agg(F.min(F.struct(*order, F.trim(column).alias("value"))).alias("f"))
    return first.select("key", F.col("f.value").alias("value"))
