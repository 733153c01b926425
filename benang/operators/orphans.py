"""References to records that do not exist, from signed change deltas.

Every change becomes a delta on the key it concerns: +1 reference where a record names the key, -1 where a record is
withdrawn or changed, +1 existence where the key gets a record, -1 existence where it is removed. The counts per key are sums of deltas, so they can
be kept in a table and brought up to date by adding the counts of the new deltas (``merge_counts``). A key with
positive references and no existence is an orphan.

Defined results: blank references (null, '', blanks, 'None') are not references; a record naming itself is not
one either; repeated rows count once; null ids of removal events are ignored; empty tables give empty reports.
Columns besides those named are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benang.functions.ids import filled_id

REFERENCE = "src_table string, tweet_id string, ref_field string, missing_id string, period string"


def references(df: DataFrame, src_table: str, fields: list[str], time: str | None = None) -> DataFrame:
    """One row per filled reference to another record; repeated rows remain."""
    own = filled_id(F.col("tweet_id"))
    period = F.coalesce(F.substring(F.col(time), 1, 7), F.lit("")) if time else F.lit("")
    refs = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), filled_id(F.col(f)).alias("missing_id")) for f in fields]))
    return (
        df.select(own.alias("tweet_id"), period.alias("period"), refs.alias("r"))
        .select(F.lit(src_table).alias("src_table"), "tweet_id", "r.ref_field", "r.missing_id", "period")
        .where(F.col("missing_id").isNotNull() & (~F.col("missing_id").eqNullSafe(F.col("tweet_id"))))
    )


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """+1 for each reference, -1 (``sign``) for each that is taken back."""
    return refs.select(F.col("missing_id").alias("key"), F.lit(sign).alias("refs"), F.lit(0).alias("rows"), F.lit(None).cast("struct<at:timestamp,removed:int>").alias("last"))


def existence_deltas(records: DataFrame, sign: int = 1) -> DataFrame:
    return records.select(filled_id(F.col("tweet_id")).alias("key"), F.lit(0).alias("refs"), F.lit(sign).alias("rows"), F.lit(None).cast("struct<at:timestamp,removed:int>").alias("last")).where(F.col("key").isNotNull())


def removal_deltas(log: DataFrame) -> DataFrame:
    """The latest event decides; at equal times a removal holds."""
    removed = (F.lower(F.trim("event_kind")) == "removed").cast("int")
    return log.select(
        filled_id(F.col("tweet_id")).alias("key"), F.lit(0).alias("refs"), F.lit(0).alias("rows"),
        F.struct(F.col("event_at").cast("timestamp").alias("at"), F.coalesce(removed, F.lit(0)).alias("removed")).alias("last"),
    ).where(F.col("key").isNotNull())


def counts(deltas: DataFrame) -> DataFrame:
    """Signed counts per key; partial sums run before the shuffle, so a hot key costs one row per task."""
    return deltas.groupBy("key").agg(F.sum("refs").cast("long").alias("refs"), F.sum("rows").cast("long").alias("rows"), F.max("last").alias("last"))


def merge_counts(state: DataFrame, new: DataFrame) -> DataFrame:
    """State of counts brought up to date with the counts of new deltas."""
    return counts(state.unionByName(new))


def existence(state: DataFrame) -> DataFrame:
    """Signed existence: one for a key with records, less one where its latest event removed it."""
    signed = F.when(F.col("rows") > 0, 1).otherwise(0) - F.coalesce(F.col("last.removed"), F.lit(0))
    return state.withColumn("existence", signed)


def orphan_keys(state: DataFrame) -> DataFrame:
    return existence(state).where((F.col("refs") > 0) & (F.col("existence") <= 0)).select(F.col("key").alias("missing_id"))


def orphans(refs: DataFrame, records: DataFrame, log: DataFrame) -> DataFrame:
    """The references whose key is an orphan."""
    deltas = reference_deltas(refs).unionByName(existence_deltas(records)).unionByName(removal_deltas(log))
    return refs.join(orphan_keys(counts(deltas)), "missing_id")


def maintained(threads: DataFrame, pilot: DataFrame, log: DataFrame) -> DataFrame:
    """The orphan keys of a state that is kept by two batches of changes: what was fetched before the middle of the time,
    with the later references wrongly counted too; then their withdrawal, and the rest. Equal to the one-shot keys."""
    refs = references(threads.select("tweet_id", "root_tweet_id", "in_reply_to_tweet_id", "captured_at"), "threads", ["root_tweet_id", "in_reply_to_tweet_id"])
    middle = threads.agg(F.percentile_approx(F.unix_micros("captured_at"), F.lit(0.5))).first()[0] or 0
    early = F.unix_micros("captured_at") < middle
    late = threads.where(~F.coalesce(early, F.lit(False)))
    late_refs = references(late, "threads", ["root_tweet_id", "in_reply_to_tweet_id"])
    others = references(pilot, "pilot_raw", ["root_tweet_id"])
    state = counts(reference_deltas(refs).unionByName(existence_deltas(threads.where(early))))
    taken = counts(reference_deltas(late_refs, -1))
    new = counts(reference_deltas(late_refs).unionByName(reference_deltas(others)).unionByName(existence_deltas(late)).unionByName(removal_deltas(log)))
    return orphan_keys(merge_counts(merge_counts(state, taken), new))


def found(threads: DataFrame, pilot: DataFrame, log: DataFrame) -> DataFrame:
    refs = references(threads, "threads", ["root_tweet_id", "in_reply_to_tweet_id"]).unionByName(references(pilot, "pilot_raw", ["root_tweet_id"]))
    return orphans(refs, threads, log).select("src_table", "tweet_id", "ref_field", "missing_id").distinct()


def report(threads: DataFrame, pilot: DataFrame, log: DataFrame) -> DataFrame:
    """Orphan references per table, field and month of waktu_posting ('' where that is blank or absent)."""
    refs = references(threads, "threads", ["root_tweet_id", "in_reply_to_tweet_id"], "waktu_posting").unionByName(references(pilot, "pilot_raw", ["root_tweet_id"]))
    return (
        orphans(refs, threads, log).distinct()
        .groupBy("src_table", "ref_field", "period")
        .agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("missing_id").alias("n_missing"))
    )
