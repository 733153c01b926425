"""Splits that keep related records together: hash-to-min components and weighted rendezvous hashing.

Entities are the values of one column (threads) tied by another (posts fetched under several threads). Clusters are
kept as rows (node, member), never as arrays, so a giant component stays spread over tasks. In each round every
node sends its cluster to the cluster's minimum and the minimum to every member, until nothing changes.

Defined results: blank roots tie nothing; rows with a blank root are split by their own id; repeated rows count
once; an empty table gives empty results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benang.functions.ids import filled_id
from benang.session import Scratch

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def ties(threads: DataFrame) -> DataFrame:
    """Pairs (root, least root) of roots under which one post has rows; a star per post, not all pairs."""
    rows = threads.select(filled_id(F.col("tweet_id")).alias("post"), filled_id(F.col("root_tweet_id")).alias("root")).where("post is not null and root is not null")
    several = rows.groupBy("post").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("post", "least")
    return rows.join(several, "post").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch | None = None, hot: int = 100_000) -> DataFrame:
    """(node, component) of undirected edges (a, b); the component is named by its least node. The rows of a node with
    more than ``hot`` members (or a thousandth of all rows) are salted over several tasks, so that the least node of a
    giant component is no single key; there are at most a thousand such nodes."""
    scratch = scratch or Scratch(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cluster = both.select(F.col("a").alias("node"), F.col("b").alias("member")).unionByName(both.select(F.col("a").alias("node"), F.col("a").alias("member"))).distinct()
    cluster = scratch.save(cluster)
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
    seen = digest(cluster)
    while True:
        least = scratch.save(cluster.groupBy("node").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("n")))
        sizes = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        bound = max(hot, sizes[0] // 1000)
        if sizes[1] > bound:
            pieces = (F.col("n") / bound + 1).cast("int")
            salts = F.broadcast(least.where(F.col("n") > bound).select("node", pieces.alias("pieces")))
            spread = cluster.join(salts, "node", "left").withColumn("salt", F.pmod(F.xxhash64("member"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
            copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > bound, pieces - 1).otherwise(0)))).drop("n")
            sent = spread.join(copies, ["node", "salt"])
        else:
            sent = cluster.join(least.drop("n"), "node")
        sent = sent.select(F.explode(F.array(
            F.struct(F.col("least").alias("node"), F.col("member").alias("member")),
            F.struct(F.col("member").alias("node"), F.col("least").alias("member")),
        )).alias("s")).select("s.node", "s.member")
        nxt = scratch.save(sent.distinct())
        scratch.drop(cluster)
        scratch.drop(least)
        cluster, now = nxt, digest(nxt)
        if now == seen:
            return cluster.groupBy("node").agg(F.min("member").alias("component"))
        seen = now


def rendezvous(key: Column, weights: dict[str, float], seed: str = "benang") -> Column:
    """The split with the greatest -weight / ln(u), u hashed from key and split: shares follow the weights and a
    changed weight moves only the share it must."""
    def score(name: str, weight: float) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), key)), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))
        return F.struct((-F.lit(float(weight)) / F.ln(u)).alias("score"), F.lit(name).alias("split"))

    return F.greatest(*[score(n, w) for n, w in weights.items() if w > 0]).getField("split") if len(weights) > 1 else F.lit(next(iter(weights)))


def tied(threads: DataFrame) -> DataFrame:
    """(root_tweet_id, component) of every thread that is tied to another: one row per thread, whatever the component's size."""
    return components(ties(threads)).select(F.col("node").alias("root_tweet_id"), "component")


def found(threads: DataFrame) -> DataFrame:
    """Pairs of roots that must share a split; the pairs of a component are the result asked for."""
    comp = Scratch(threads.sparkSession).save(components(ties(threads)))
    left = comp.select("component", F.col("node").alias("root_a"))
    right = comp.select("component", F.col("node").alias("root_b"))
    return left.join(right, "component").where("root_a < root_b").select("root_a", "root_b")


def assign(threads: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each (tweet_id, root_tweet_id) with its component and split."""
    comp = components(ties(threads)).withColumnRenamed("node", "root")
    rows = threads.select(filled_id(F.col("tweet_id")).alias("tweet_id"), filled_id(F.col("root_tweet_id")).alias("root")).where("tweet_id is not null").distinct()
    # a post with filled and blank roots follows its filled one
    least = rows.groupBy("tweet_id").agg(F.min("root").alias("least"))
    rows = rows.join(least, "tweet_id").withColumn("root", F.coalesce("root", "least", "tweet_id")).drop("least").distinct()
    named = rows.join(comp, "root", "left").withColumn("component", F.coalesce("component", "root"))
    return named.select("tweet_id", F.col("root").alias("root_tweet_id"), "component", rendezvous(F.col("component"), weights or SPLITS).alias("split"))


def shares(threads: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows, components and share reached per split, next to the share asked for."""
    weights = weights or SPLITS
    total = sum(weights.values())
    per = assign(threads, weights).groupBy("split", "component").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_components"))
    goal = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w / total))])
    all_rows = F.sum("n_rows").over(W.partitionBy(F.lit(1)))  # one row per split
    return per.select("split", "n_rows", "n_components", (F.col("n_rows") / all_rows).alias("share"), goal[F.col("split")].alias("target_share"))
