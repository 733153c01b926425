"""Log odds of terms between two kinds of texts, fitted by Spark on a bounded sample and handed out as a dictionary."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = "term string, n0 double, n1 double"


def sampled(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, by a threshold on the hash of a key: no ordering, the same rows every time."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * rows / total))


class Odds:
    """A naive Bayes model: the prior and the weight of each term; unknown terms weigh nothing."""

    def __init__(self, prior: float, weights: dict[str, float]):
        self.prior, self.weights = prior, weights

    def of(self, terms) -> float:
        return self.prior + sum(w for w in map(self.weights.get, terms) if w)


def fit(rows: DataFrame, labelled: Callable[[pd.DataFrame], Iterator[tuple[list[str], float]]], least: int = 3, most_terms: int = 200_000, smooth: float = 0.5, most_prior: float = 0.1) -> Odds:
    """Counts of terms in texts of label 0 and 1. ``labelled`` gives (terms, probability of label 1) of each text of a
    batch. Counts are added up per task before they are shuffled; the dictionary holds at most ``most_terms`` terms,
    those met most often, each at least ``least`` times. The prior of label 1 is that of the sample, ``most_prior`` at most."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[float]] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(t, n[0], n[1]) for t, n in held.items()], columns=["term", "n0", "n1"])

        for b in batches:
            for terms, p in labelled(b):
                for t in ("", *set(terms)):
                    n = held.get(t)
                    if n is None:
                        n = held[t] = [0.0, 0.0]
                    n[0] += 1 - p
                    n[1] += p
            if len(held) > 500_000:
                yield out()
                held.clear()
        yield out()

    counts = rows.mapInPandas(run, COUNTS).groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least)
    got = counts.orderBy(F.desc(F.col("n0") + F.col("n1")), "term").limit(most_terms + 1).collect()
    all0, all1 = next(((r["n0"], r["n1"]) for r in got if r["term"] == ""), (0.0, 0.0))
    # equal evidence on both sides weighs nothing, however unequal the sides are
    scale = (all1 + 1) / (all0 + all1 + 2)
    weights = {
        r["term"]: math.log((r["n1"] + 2 * smooth * scale) / (all1 + 2 * smooth * scale + 1)) - math.log((r["n0"] + 2 * smooth * (1 - scale)) / (all0 + 2 * smooth * (1 - scale) + 1))
        for r in got if r["term"]
    }
    return Odds(math.log(min((all1 + 1) / (all0 + 1), most_prior / (1 - most_prior))), weights)
