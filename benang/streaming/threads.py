"""Streams of records: first-test-wins discovery, deferred replies, exactly-once by id, quotas, reply states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benang.functions.text import good_quality, language_matches
from benang.operators.relations import DIRECT, NESTED, ROOT, is_root, with_level
from benang.session import Scratch

# states of a root
DIRECT_DONE, ALL_DONE, NOT_ROOT, FAILED = "direct_exhausted", "all_exhausted", "invalid_root", "failed"


def discovery_reason(df: DataFrame, required_language: str = "in") -> Column:
    """Why a record is no new root: the first failing test of root, language, quality; null for one to keep."""
    root = is_root(F.col("teks_komentar"), F.col("tweet_id"), F.col("conversation_id"), F.col("in_reply_to_tweet_id"))
    return F.when(~root, "root").when(~language_matches(F.col("bahasa"), required_language), "language").when(~good_quality(F.col("teks_komentar")), "quality")


def discover(df: DataFrame, seen: DataFrame | None = None, required_language: str = "in") -> DataFrame:
    """Records with ``reason``: dedup first (seen before, or a repeat in the batch: the earliest fetch stays)."""
    n = with_level(df)
    rn = F.row_number().over(W.partitionBy("tweet_id").orderBy("captured_at", "root_tweet_id", "jumlah_likes"))
    n = n.withColumn("repeat", rn > 1)
    if seen is not None:
        n = n.join(seen.select("tweet_id", F.lit(True).alias("seen")).distinct(), "tweet_id", "left")
    else:
        n = n.withColumn("seen", F.lit(False))
    return n.withColumn("reason", F.when(F.col("repeat") | F.coalesce("seen", F.lit(False)), "dedup").otherwise(discovery_reason(n, required_language))).drop("repeat", "seen")


def deferred(df: DataFrame) -> DataFrame:
    """Replies whose root is verified in the same data, whatever the order they came in; replies of roots that never
    come are left out."""
    n = with_level(df)
    verified = n.where((F.col("level") == ROOT) & is_root(F.col("teks_komentar"), F.col("tweet_id"), F.col("conversation_id"), F.col("in_reply_to_tweet_id"))).select(F.col("tweet_id").alias("root_tweet_id")).distinct()
    return n.where(F.col("level").isin(DIRECT, NESTED)).join(verified, "root_tweet_id", "left_semi")


RELEASED = "tweet_id string, root_tweet_id string"


def stream_deferred(spark: SparkSession, source: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The deferred replies of a stream of files: what came before its root is released when the root comes.

    Each batch writes one table of its rows and those kept: what is released, and what is kept for the next, one row of
    each verified root and each reply still held. Repeats of a post over batches are taken out as the result is read."""
    scratch = Scratch(spark)
    nothing = spark.createDataFrame([], RELEASED)
    kept = [nothing.withColumn("reply", F.lit(True))]
    written: list[str] = []

    def step(batch: DataFrame, number: int) -> None:
        n = with_level(batch)
        ok = (F.col("level") == ROOT) & is_root(F.col("teks_komentar"), F.col("tweet_id"), F.col("conversation_id"), F.col("in_reply_to_tweet_id"))
        # written before it is filtered: filters move below the projection and would work the ids out once for each mention
        rows = scratch.save(n.select("tweet_id", "root_tweet_id", F.col("level").isin(DIRECT, NESTED).alias("reply"), ok.alias("root_ok")))
        known = kept[0].unionByName(rows.where("reply or root_ok").drop("root_ok")).repartition("root_tweet_id").dropDuplicates(["root_tweet_id", "tweet_id", "reply"])
        waits = F.bool_and("reply").over(W.partitionBy("root_tweet_id"))
        out = scratch.save(known.withColumn("released", F.col("reply") & ~waits))
        kept[0] = out.where("not released").drop("released")
        written.append(scratch.paths[id(out)])
        scratch.drop(rows)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.option("checkpointLocation", f"{scratch.base}/mark").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    if not written:
        return nothing
    return spark.read.schema(f"{RELEASED}, reply boolean, released boolean").parquet(*written).where("released").select("tweet_id", "root_tweet_id").distinct()


def quota(df: DataFrame, target: int, order: list[str]) -> DataFrame:
    """Exactly the first ``target`` records of an order."""
    return df.orderBy(*order).limit(target)


def root_states(df: DataFrame) -> DataFrame:
    """State per root of the data: nested replies seen, only direct ones, none, or no valid root row."""
    n = with_level(df).where("root_tweet_id <> ''")
    per = n.groupBy("root_tweet_id").agg(F.count_if(F.col("level") == ROOT).alias("roots"), F.count_if(F.col("level") == DIRECT).alias("direct"), F.count_if(F.col("level") == NESTED).alias("nested"))
    return per.select("root_tweet_id", F.when(F.col("roots") == 0, NOT_ROOT).when(F.col("nested") > 0, ALL_DONE).when(F.col("direct") > 0, DIRECT_DONE).otherwise("pending").alias("status"))


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """The later state of each root wins."""
    return old.join(new.select("root_tweet_id"), "root_tweet_id", "left_anti").unionByName(new)


def append_new(batch: DataFrame, path: str, key: str = "tweet_id") -> None:
    """Rows of a batch whose key is not stored yet are appended; a batch done twice changes nothing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    try:
        known = spark.read.parquet(path).select(key)
        fresh = fresh.join(known, key, "left_anti")
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_batch: int = 1, reject=None) -> None:
    """All files of a folder not read before, in micro-batches: data first, then the stream's own checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, _: append_new(b if reject is None else reject(b), target)).start()
    query.awaitTermination()


def stream_distinct(spark: SparkSession, source: str, schema, key: str) -> DataFrame:
    """A stream of files deduplicated by key (first arrival wins), run to its end; the result as a table."""
    scratch = Scratch(spark)
    out, mark = f"{scratch.base}/stream", f"{scratch.base}/mark"
    stream = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def windowed_counts(spark: SparkSession, source: str, schema, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per window of event time and group, with a watermark."""
    scratch = Scratch(spark)
    out, mark = f"{scratch.base}/windows", f"{scratch.base}/mark"
    counts = spark.readStream.schema(schema).parquet(source).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *by).count()

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), *by, F.col("count").alias("n"), F.lit(number).alias("batch")).write.mode("append").parquet(out)

    counts.writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out).groupBy("start", *by).agg(F.max_by("n", "batch").alias("n"))
