"""Parent-child links to full hierarchies, with cycles.

Weighted disjoint sets: the links are laid out by thread, each task unites its own links into trees whose members
carry the offset to their local root (path compression on arrays), and only the local roots that continue in
another task (portals) are merged with each other. A merged portal gives its members root, depth and path by one
join. Hot threads are split over several tasks; they only add portals.

Defined results: a blank parent (null, '', blanks, 'None') makes a post a root; rows without id are ignored; rows
of one post are united (the least parent counts where they differ); a parent without record ends the chain with
``ends`` = missing and the depth counted to that absent post; a post on a cycle has ``ends`` = cycle, one that
only leads into a cycle has ``into_cycle``, both with null root, depth and path; empty tables give empty results.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benang.functions.ids import filled_id
from benang.session import Scratch, parallelism

SEPARATOR = "/"
LOCAL = "id string, anc string, off long, ends string"
BLOCK = 200_000


def nodes(threads: DataFrame) -> DataFrame:
    """One row per post: parent, thread, and the extremes of what its rows state."""
    level = F.lower(F.regexp_replace("hierarki_komentar", r"[\s_]+", ""))
    root = filled_id(F.col("root_tweet_id"))
    return (
        threads.select(filled_id(F.col("tweet_id")).alias("id"), filled_id(F.col("in_reply_to_tweet_id")).alias("parent"), root.alias("root"), F.when(level != "", level).alias("level"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("parent").alias("parent"), F.min("root").alias("root"), F.max("root").alias("root_max"), F.min("level").alias("level"), F.max("level").alias("level_max"))
    )


def unite(pdf: pd.DataFrame, with_path: bool) -> pd.DataFrame:
    """Local roots and offsets of links id -> parent with weight ``w`` (1 where absent). Pointer doubling with offsets."""
    ids = pdf["id"].to_numpy(object)
    n = len(ids)
    parent = pdf["parent"].to_numpy(object)
    weight = pdf["w"].to_numpy(np.int64) if "w" in pdf else np.ones(n, np.int64)
    index = pd.Index(ids)
    has = pd.notna(parent)
    up = np.full(n, -1, np.int64)
    up[has] = index.get_indexer(pd.Index(parent[has], dtype=object))
    self_link = up == np.arange(n)
    local = (up >= 0) & ~self_link
    ptr = np.where(local, up, np.arange(n))
    off = np.where(local, weight, 0)
    for _ in range(max(1, n).bit_length() + 1):
        nxt = ptr[ptr]
        if np.array_equal(nxt, ptr):
            break
        off = off + off[ptr]
        ptr = nxt
    settled = ~local[ptr]
    on_cycle = np.zeros(n, bool)
    on_cycle[ptr[~settled]] = True
    looped = self_link[ptr] & settled
    outside = settled & has[ptr] & ~looped
    anc = np.where(outside, parent[ptr], ids[ptr])
    off = off + np.where(outside, weight[ptr], 0)
    ends = np.where(outside, "out", "top").astype(object)
    ends[looped | ~settled] = "into_cycle"
    ends[self_link | on_cycle] = "cycle"
    if "ends" in pdf:  # portals that are settled already keep their end
        known = pdf["ends"].to_numpy(object)
        own = known[ptr]
        ends = np.where((ends == "top") & (own != "out"), np.where(own == "cycle", "into_cycle", own), ends)
        ends = np.where(known == "cycle", "cycle", ends)
        anc = np.where((own != "out") & settled, pdf["anc"].to_numpy(object)[ptr], anc)
        off = off + np.where((own != "out") & settled, pdf["off"].to_numpy(np.int64)[ptr], 0)
    out = pd.DataFrame({"id": ids, "anc": anc, "off": off, "ends": ends})
    if with_path:
        base = pdf["path"].to_numpy(object) if "path" in pdf else ids
        path: list = [None] * n
        todo = np.argsort(np.where(settled, off, -1), kind="stable")
        for i in todo:
            above = path[up[i]] if local[i] else ""
            if settled[i] and not looped[i] and above is not None and base[i] is not None:
                path[i] = above + SEPARATOR + base[i] if local[i] else base[i]
        out["path"] = path
    return out


def unite_partition(with_path: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            yield unite(pd.concat(parts, ignore_index=True), with_path)

    return run


def merge_portals(portals: DataFrame, scratch: Scratch, with_path: bool, block: int = BLOCK) -> DataFrame:
    """Portals (id, anc, off, ends[, path]) resolved through each other. One task where they fit a block, else
    rounds of doubling; ``ends`` becomes top, missing, cycle or into_cycle."""
    portals = scratch.save(portals)
    count = portals.count()
    columns = ["id", "anc", "off", "ends"] + (["path"] if with_path else [])
    if count <= block:
        links = portals.withColumn("parent", F.when(F.col("ends") == "out", F.col("anc"))).withColumn("w", F.col("off"))
        done = links.coalesce(1).mapInPandas(unite_partition(with_path), LOCAL + (", path string" if with_path else ""))
        done = done.select(*columns)
    else:
        done, rounds = portals, 0
        while rounds <= count.bit_length() + 1:
            right = done.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("off").alias("off2"), F.col("ends").alias("ends2"), *([F.col("path").alias("path2")] if with_path else []))
            open_ = done.where(F.col("ends") == "out").join(right, "anc", "left")
            met = F.col("anc2").isNotNull()
            looped = F.col("ends2").isin("cycle", "into_cycle")
            stepped = open_.select(
                "id", F.coalesce("anc2", "anc").alias("anc"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"),
                F.when(met & looped, "into_cycle").when(met, F.col("ends2")).otherwise("missing").alias("ends"),
                *([F.concat_ws(SEPARATOR, F.when(met, F.col("path2")).otherwise(F.col("anc")), "path").alias("path")] if with_path else []),
            )
            nxt = scratch.save(done.where(F.col("ends") != "out").select(*columns).unionByName(stepped))
            rounds += 1
            if done is not portals:
                scratch.drop(done)
            done = nxt
            if done.where(F.col("ends") == "out").isEmpty():
                break
        done = done.withColumn("ends", F.when(F.col("ends") == "out", "into_cycle").otherwise(F.col("ends")))
    if with_path:  # the path begins with the absent parent
        done = done.withColumn("path", F.when(F.col("ends") == "out", F.concat_ws(SEPARATOR, "anc", "path")).otherwise(F.col("path")))
    done = done.withColumn("ends", F.when(F.col("ends") == "out", "missing").otherwise(F.col("ends")))
    return scratch.save(done)


def cycle_members(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Ids on cycles, of links id -> parent that all lead into cycles: the image of ever longer walks, until it
    stays the same."""
    step = scratch.save(links.select("id", F.col("parent").alias("far")))
    before = step.count()
    while True:
        image = step.select(F.col("far").alias("id")).distinct()
        far = scratch.save(step.join(image, "id"))
        size = far.count()
        if size == before:
            return far.select("id")
        before = size
        onward = far.select(F.col("id").alias("far"), F.col("far").alias("next"))
        step = scratch.save(far.join(onward, "far").select("id", F.col("next").alias("far")))


def resolve(links: DataFrame, with_path: bool = False, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """Links (id, parent, root, ...) with top, depth, ends and, on request, path.

    ``root`` is only used to lay out the tasks."""
    spark = links.sparkSession
    scratch = Scratch(spark)
    links = scratch.save(links)
    hot = links.groupBy(F.coalesce("root", "id").alias("thread")).agg(F.count(F.lit(1)).alias("n"))
    sizes = hot.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    n = tasks or parallelism(spark, sizes["rows"] or 0, block)
    thread = F.coalesce("root", "id")
    spread = links.select("id", "parent", thread.alias("thread"))
    if (sizes["most"] or 0) > block:
        heavy = hot.where(F.col("n") > block).select("thread", (F.col("n") / block + 1).cast("int").alias("pieces"))
        spread = spread.join(F.broadcast(heavy) if (sizes["rows"] // block) < 100_000 else heavy, "thread", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))))
        spread = spread.repartition(n, "thread", "salt")
    else:
        spread = spread.repartition(n, "thread")
    schema = LOCAL + (", path string" if with_path else "")
    level0 = scratch.save(spread.select("id", "parent").mapInPandas(unite_partition(with_path), schema))
    outs = level0.where(F.col("ends") == "out").select(F.col("anc").alias("id")).distinct()
    portals = merge_portals(level0.join(outs, "id", "left_semi"), scratch, with_path, block)
    right = portals.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("off").alias("off2"), F.col("ends").alias("ends2"), *([F.col("path").alias("path2")] if with_path else []))
    crossing = level0.where(F.col("ends") == "out").join(right, "anc", "left")
    met = F.col("anc2").isNotNull()
    looped = F.col("ends2").isin("cycle", "into_cycle")
    crossed = crossing.select(
        "id", F.coalesce("anc2", "anc").alias("anc"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"),
        F.when(met & looped, "into_cycle").when(met, F.col("ends2")).otherwise("missing").alias("ends"),
        *([F.when(met, F.concat_ws(SEPARATOR, "path2", "path")).otherwise(F.concat_ws(SEPARATOR, "anc", "path")).alias("path")] if with_path else []),
    )
    done = level0.where(F.col("ends") != "out").unionByName(crossed)
    if not portals.where(F.col("ends").isin("cycle", "into_cycle")).isEmpty():
        open_ids = crossed.where(F.col("ends") == "into_cycle").select("id")
        cycles = cycle_members(links.join(open_ids, "id", "left_semi").where(F.col("parent").isNotNull()), scratch)
        done = done.join(cycles.withColumn("on", F.lit(True)), "id", "left").withColumn("ends", F.when(F.col("on"), "cycle").otherwise(F.col("ends"))).drop("on")
    ok = F.col("ends").isin("top", "missing")
    return done.select(
        "id", F.when(ok, F.col("anc")).alias("top"), F.when(ok, F.col("off")).alias("depth"), "ends",
        *([F.when(ok, F.col("path")).alias("path")] if with_path else []),
    )


def found(threads: DataFrame, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """Faults per post: cycle, wrong_root, wrong_level."""
    scratch = Scratch(threads.sparkSession)
    links = scratch.save(nodes(threads))
    tree = resolve(links.select("id", "parent", "root"), block=block, tasks=tasks)
    stated = links.select("id", F.col("root").alias("r1"), F.col("root_max").alias("r2"), "level", "level_max")
    both = tree.join(stated, "id")
    want = F.when(F.col("depth") == 0, "roottweet").when(F.col("depth") == 1, "directreply").otherwise("nestedreply")
    top = F.col("ends") == "top"
    faults = F.array(
        F.when(F.col("ends") == "cycle", "cycle"),
        F.when(top & ((F.col("r1") != F.col("top")) | (F.col("r2") != F.col("top"))), "wrong_root"),
        F.when(top & ((F.col("level") != want) | (F.col("level_max") != want)), "wrong_level"),
    )
    return both.select(F.col("id").alias("tweet_id"), F.explode(F.array_compact(faults)).alias("fault"))


def paths(threads: DataFrame, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """tweet_id, top, depth, ends, path (ids from the top down, joined by '/')."""
    return resolve(nodes(threads).select("id", "parent", "root"), with_path=True, block=block, tasks=tasks).withColumnRenamed("id", "tweet_id")


def descendants(tree: DataFrame) -> DataFrame:
    """ancestor, tweet_id, distance: one row per post below another, from the paths."""
    steps = F.posexplode(F.split("path", SEPARATOR)).alias("pos", "ancestor")
    return tree.where(F.col("path").isNotNull()).select("tweet_id", "depth", steps).where(F.col("ancestor") != F.col("tweet_id")).select("ancestor", "tweet_id", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(tree: DataFrame) -> DataFrame:
    below = descendants(tree).groupBy(F.col("ancestor").alias("tweet_id")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))
    return below


def rings(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, far, steps: every other member of the cycle of an id with the way up to it, of links id -> parent of cycle
    members only; walks of doubled length until nothing new is met."""
    met = scratch.save(links.where(F.col("id") != F.col("parent")).select("id", F.col("parent").alias("far"), F.lit(1).cast("long").alias("steps")))
    before, reach = met.count(), 1
    while True:
        on = met.select(F.col("id").alias("far"), F.col("far").alias("next"), F.col("steps").alias("more"))
        longer = met.where(F.col("steps") == reach).join(on, "far").where(F.col("next") != F.col("id")).select("id", F.col("next").alias("far"), (F.col("steps") + F.col("more")).alias("steps"))
        nxt = scratch.save(met.unionByName(longer).groupBy("id", "far").agg(F.min("steps").alias("steps")))
        scratch.drop(met)
        met, reach, size = nxt, 2 * reach, nxt.count()
        if size == before:
            return met
        before = size


def relations(threads: DataFrame, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """ancestor, tweet_id, distance over whole threads, cycles and what hangs below them included.

    Every post is an ancestor of whatever reaches it by parents, the nearest way counts; on a cycle every member is
    above every other and above all that leads into it, none above itself. An absent parent is an ancestor too."""
    scratch = Scratch(threads.sparkSession)
    links = scratch.save(nodes(threads).select("id", "parent", "root"))
    tree = scratch.save(resolve(links, with_path=True, block=block, tasks=tasks).withColumnRenamed("id", "tweet_id"))
    looped = scratch.save(tree.where(F.col("ends").isin("cycle", "into_cycle")).select(F.col("tweet_id").alias("id"), "ends"))
    out = descendants(tree)
    if looped.isEmpty():
        return out
    # cut every cycle above each of its members: what hangs below a member is then a tree with that member as its top
    inside = scratch.save(links.join(looped, "id"))
    cut = inside.select("id", F.when(F.col("ends") != "cycle", F.col("parent")).alias("parent"), "root")
    below = scratch.save(resolve(cut, with_path=True, block=block, tasks=tasks).withColumnRenamed("id", "tweet_id"))
    ring = rings(inside.where(F.col("ends") == "cycle"), scratch).withColumnRenamed("id", "top")
    round_ = below.join(ring, "top").select(F.col("far").alias("ancestor"), "tweet_id", (F.col("depth") + F.col("steps")).alias("distance"))
    return out.unionByName(descendants(below)).unionByName(round_)


def family_sizes(threads: DataFrame, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """tweet_id, n_descendants, height: one row per post, 0 and 0 without descendants; cycles as in relations()."""
    some = relations(threads, block, tasks).select(F.col("ancestor").alias("tweet_id"), F.lit(1).alias("n"), "distance")
    every = nodes(threads).select(F.col("id").alias("tweet_id"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("distance"))
    return some.unionByName(every).groupBy("tweet_id").agg(F.sum("n").alias("n_descendants"), F.max("distance").alias("height"))
