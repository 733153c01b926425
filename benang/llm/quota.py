"""Sample matching target category proportions: top-down allocation over a category tree.

The tree is a table (node, parent) of any depth. The quota of a plan starts at its root: sample_rows times the shares of
its rows. Every node hands its quota down to its children in proportion to the shares below them, until leaves are
reached; a leaf asks for min_rows at least. What leaves cannot meet is pooled and passed first to their siblings, then to
their cousins under the next node up, and so on, each as far as rows are available, in proportion to the room they have.
Rows are drawn at the leaves by a permuted dense rank: within a thread rows are ranked by a hash, at most
``max_per_root`` of them count, and the draw takes the lowest hashes of those.

Defined results: spelling variants of a stratum are one stratum (letters only, any case); blank strata and blank
ids are no candidates; a repeated row counts once; a post without a filled root in threads has its own id as
root; a post under several roots belongs to the least one; null shares, sizes or minima count as 0, a null cap as
no cap; a plan row whose stratum has no candidates has 0 available; a stratum the tree does not hold hangs at its root;
empty tables give empty results.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from benang.functions.ids import filled_id
from benang.session import Scratch, broadcast_if_small

#: the category tree where none is given: (node, parent)
TREE = [("mutugizisignal", "single"), ("tatakelolasignal", "single"), ("distribusisignal", "single"), ("overlap", "other"), ("nosignal", "other"), ("single", "all"), ("other", "all")]
NO_CAP = 2**31 - 1


def letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))


def candidates(coordinator: DataFrame, threads: DataFrame) -> DataFrame:
    """Distinct (tweet_id, stratum) with the root of the post."""
    c = coordinator.select(filled_id(F.col("tweet_id")).alias("tweet_id"), letters(F.col("sampling_stratum")).alias("stratum")).where("tweet_id is not null and stratum <> ''").distinct()
    roots = threads.select(filled_id(F.col("tweet_id")).alias("tweet_id"), filled_id(F.col("root_tweet_id")).alias("root")).where("tweet_id is not null and root is not null")
    roots = roots.groupBy("tweet_id").agg(F.min("root").alias("root"))
    return c.join(roots, "tweet_id", "left").withColumn("root", F.coalesce("root", "tweet_id"))


def plan_rows(plans: DataFrame) -> DataFrame:
    return plans.select(
        "plan_name", "sampling_stratum", letters(F.col("sampling_stratum")).alias("stratum"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"),
        F.coalesce("max_per_root", F.lit(NO_CAP)).alias("cap"), F.coalesce("sample_rows", F.lit(0)).alias("sample_rows"),
    )


def available(cands: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan rows with the number of rows available. Threads are first counted by how many candidates they hold, so
    what meets the plans is one row per stratum and thread size."""
    held = cands.groupBy("stratum", "root").agg(F.count(F.lit(1)).alias("held")).groupBy("stratum", "held").agg(F.count(F.lit(1)).alias("roots"))
    p = plan_rows(plans)
    met = p.select("stratum", "cap").distinct().join(held, "stratum").groupBy("stratum", "cap").agg(F.sum(F.least("held", F.col("cap").cast("long")) * F.col("roots")).alias("available"))
    return p.join(met, ["stratum", "cap"], "left").withColumn("available", F.coalesce("available", F.lit(0)))


def parents(tree: DataFrame | None, most: int = 100_000) -> dict[str, str]:
    """The tree as node -> parent; a tree of categories, refused beyond ``most`` nodes and where it has a cycle."""
    rows = TREE if tree is None else [tuple(r) for r in tree.select("node", "parent").where("node is not null and parent is not null").distinct().limit(most + 1).collect()]
    up = dict(rows)
    if len(rows) > most or len(up) < len(rows):
        raise ValueError("the tree is too large or a node has two parents")
    for node in up:
        if len(chain(node, up)) > len(up) + 1:
            raise ValueError("the tree has a cycle")
    return up


def chain(node: str, up: dict[str, str], top: str = "") -> list[str]:
    """The nodes above a leaf, nearest first; every chain ends in ``top``."""
    out = []
    while node in up and len(out) <= len(up):
        node = up[node]
        out.append(node)
    return [*out, top]


def spread(give: int, room: list[int], order: list[int]) -> list[int]:
    """Whole rows of ``give`` over ``room`` in proportion, the rest by greatest remainder, then by ``order``."""
    total = sum(room)
    give = min(give, total)
    if give <= 0:
        return [0] * len(room)
    out = [give * r // total for r in room]
    for i in sorted(range(len(room)), key=lambda i: (-(give * room[i] % total), order[i]))[:give - sum(out)]:
        out[i] += 1
    return out


def descend(shares: list[Fraction], chains: list[list[str]], size: int) -> list[Fraction]:
    """Leaf quotas: the whole quota goes from the root down, each node's to its children by the shares below them."""
    below: dict[tuple, Fraction] = {}
    paths = [tuple(reversed(c)) for c in chains]
    for p, s in zip(paths, shares):
        for k in range(1, len(p) + 1):
            below[p[:k]] = below.get(p[:k], Fraction(0)) + s
    out = []
    for p, s in zip(paths, shares):
        quota = size * below[p[:1]]
        for k in range(2, len(p) + 1):
            quota = quota * below[p[:k]] / below[p[:k - 1]] if below[p[:k - 1]] else Fraction(0)
        out.append(quota * s / below[p] if below[p] else Fraction(0))
    return out


def allocate_plan(pdf: pd.DataFrame, up: dict[str, str] | None = None) -> pd.DataFrame:
    """Quotas of one plan (a few rows: one per stratum). Fractions are exact, so a quota is what the share says."""
    up = dict(TREE) if up is None else up
    pdf = pdf.sort_values(["sampling_stratum", "cap", "target_share"], kind="stable").reset_index(drop=True)
    n = len(pdf)
    room = [int(a) for a in pdf["available"]]
    chains = [chain(s, up) for s in pdf["stratum"]]
    size = int(pdf["sample_rows"].max()) if n else 0
    # rows of a plan may name different sizes; each share is then taken of its own
    shares = [Fraction(float(s)) * int(k) / size if size else Fraction(0) for s, k in zip(pdf["target_share"], pdf["sample_rows"])]
    want = [max(float(q), float(m)) for q, m in zip(descend(shares, chains, size), pdf["min_rows"])]
    goal = [math.ceil(w) if w < 1 else math.floor(w + 0.5) for w in want]
    take = [min(g, r) for g, r in zip(goal, room)]
    received = [0] * n
    pools: dict[tuple, int] = {}
    for i in range(n):
        key = tuple(chains[i])
        pools[key] = pools.get(key, 0) + goal[i] - take[i]
    while pools:
        above: dict[tuple, int] = {}
        deepest = max(map(len, pools))
        for key in sorted(pools):
            pool = pools[key]
            if len(key) == deepest:
                under = [i for i in range(n) if tuple(chains[i][-len(key):]) == key]
                for i, g in zip(under, spread(pool, [room[i] - take[i] for i in under], under)):
                    take[i], received[i], pool = take[i] + g, received[i] + g, pool - g
                key = key[1:]
            if key:
                above[key] = above.get(key, 0) + pool
        pools = above
    out = pdf[["plan_name", "sampling_stratum", "stratum", "cap", "available"]].copy()
    out["target_rows"] = want
    out["unmet"] = [max(0.0, w - r) for w, r in zip(want, room)]
    out["quota"] = take
    out["received"] = received
    return out


ALLOCATION = "plan_name string, sampling_stratum string, stratum string, cap int, available long, target_rows double, unmet double, quota long, received long"


def allocate(avail: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """The plan rows with their quotas; a group is one plan, whose size is its number of strata."""
    up = parents(tree)
    return avail.groupBy("plan_name").applyInPandas(lambda p: allocate_plan(p, up), ALLOCATION)


def found(coordinator: DataFrame, threads: DataFrame, plans: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Plan rows whose leaf could not meet the quota that came down to it."""
    a = allocate(available(candidates(coordinator, threads), plans), tree)
    return a.where("unmet > 0").select("plan_name", "sampling_stratum").distinct()


def draw(coordinator: DataFrame, threads: DataFrame, plans: DataFrame, seed: str = "benang", tree: DataFrame | None = None, range_rows: int = 200_000) -> DataFrame:
    """The sample: plan_name, sampling_stratum, tweet_id, root_tweet_id."""
    cands = Scratch(coordinator.sparkSession).save(candidates(coordinator, threads))
    quotas = allocate(available(cands, plans), tree)
    most = plan_rows(plans).agg(F.coalesce(F.max("cap"), F.lit(0))).first()[0]
    h = F.md5(F.concat_ws("|", F.lit(seed), "tweet_id"))
    ranked = cands.withColumn("h", h).withColumn("in_root", F.dense_rank().over(W.partitionBy("stratum", "root").orderBy("h", "tweet_id")))
    # the constant limit lets Spark cut each thread before it is shuffled
    ranked = ranked.where(F.col("in_root") <= most)
    met = ranked.join(broadcast_if_small(quotas.where("quota > 0"), plans), "stratum").where("in_root <= cap")
    # a hot stratum is ranked within hash ranges of bounded size; only rows that can still be drawn go on
    digits = 1 + math.ceil(math.log(max(1.0, cands.count() / range_rows), 16))
    salted = met.withColumn("range", F.substring("h", 1, digits))
    first = salted.withColumn("r", F.dense_rank().over(W.partitionBy("plan_name", "sampling_stratum", "cap", "range").orderBy("h", "tweet_id"))).where("r <= quota")
    sizes = first.groupBy("plan_name", "sampling_stratum", "cap", "range").agg(F.max("r").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("plan_name", "sampling_stratum", "cap").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    drawn = first.join(before, ["plan_name", "sampling_stratum", "cap", "range"]).where("before + r <= quota")
    return drawn.select("plan_name", "sampling_stratum", "tweet_id", F.col("root").alias("root_tweet_id"))
