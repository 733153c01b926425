"""Audits of the record contract: counts, distributions, relation flags, reply statistics, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benang.functions.ids import normalize_id
from benang.functions.text import SCIENTIFIC, collapse, nfkc, text_or_blank
from benang.operators.relations import CORE, DIRECT, NESTED, ROOT, difference, one_row, orphan_replies

IDS = CORE[:4]
QUANTILES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def blank(c: Column) -> Column:
    return F.trim(text_or_blank(c.cast("string"))) == ""


def violations() -> dict[str, Column]:
    """Rows whose ids do not suit their stated level."""
    t, r, c, p = (normalize_id(F.col(x)) for x in IDS)
    lv = F.col("hierarki_komentar")
    return {
        "bad_roots": (lv == ROOT) & ~((t == r) & (r == c) & (p == "")),
        "bad_direct": (lv == DIRECT) & ~((p == r) & (r == c) & (p != "") & (t != "")),
        "bad_nested": (lv == NESTED) & ~((c == r) & (p != "") & (p != r)),
    }


def audit(df: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One row: totals, distinct ids, duplicate rows beyond the first, malformed ids, blanks, relation violations,
    orphans and, with a state of ids, what either side lacks."""
    t = normalize_id(F.col("tweet_id"))
    filled = [normalize_id(F.col(c)) for c in IDS]
    bad = F.lit(False)
    science = F.lit(False)
    for c in filled:
        bad = bad | ((c != "") & ~c.rlike("^[0-9]+$"))
        science = science | c.rlike(SCIENTIFIC)
    main = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(bad).alias("invalid_ids"), F.count_if(science).alias("scientific_ids"), *[F.count_if(blank(F.col(c))).alias(f"blank_{c}") for c in ("tweet_id", "root_tweet_id", "waktu_posting", "username", "teks_komentar", "sumber_akuisisi", "hierarki_komentar")],
        F.count_if(F.col("hierarki_komentar") == ROOT).alias("root_rows"), *[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in violations().items()],
    )
    # one aggregation per id, then counts over it: no row is multiplied for its distinct columns
    per_id = df.where(t != "").groupBy(t.alias("id")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("distinct_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    per_root = df.where(filled[1] != "").select(filled[1]).distinct().agg(F.count(F.lit(1)).alias("distinct_roots"))
    parts = [main, per_id, per_root, orphan_replies(df).agg(F.count(F.lit(1)).alias("orphans"))]
    if state is not None:
        d = difference(df.select(t.alias("tweet_id")).where("tweet_id <> ''"), state.select(normalize_id(F.col("tweet_id")).alias("tweet_id")), "tweet_id")
        parts.append(d.agg(F.count_if(F.col("side") == "left_only").alias("data_only"), F.count_if(F.col("side") == "right_only").alias("state_only")))
    return one_row(*parts)


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Distinct ids that come more than once."""
    return df.where(~blank(F.col("tweet_id"))).groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def replies_per_root(df: DataFrame) -> DataFrame:
    """Direct replies of each root that has some."""
    return df.where((F.col("hierarki_komentar") == DIRECT) & ~blank(F.col("root_tweet_id"))).groupBy("root_tweet_id").agg(F.count(F.lit(1)).alias("n_replies"))


def reply_statistics(df: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, median, sample deviation and interpolated quantiles of replies per root; 0 when empty."""
    n = F.col("n_replies").cast("double")
    q = F.percentile(n, F.array(*[F.lit(x) for x in QUANTILES]))
    out = replies_per_root(df).agg(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), q.alias("q"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*[zero(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")], *[zero(F.col("q")[i]).alias(f"q{int(x * 100)}") for i, x in enumerate(QUANTILES)])


def heavy_roots(df: DataFrame, least: int = 200) -> DataFrame:
    return replies_per_root(df).where(F.col("n_replies") >= least)


def dataset_audit(df: DataFrame) -> DataFrame:
    """One row: rows, distinct and repeated ids, rows per level, roots with direct replies, whether all roots and all
    direct replies keep their relations (true where there are none), orphans, rows without text, and the statistics of
    replies per root."""
    lv, text = F.col("hierarki_komentar"), F.col("teks_komentar")
    broken = violations()
    # rows per id first, so that no column is counted by distinct rows over all rows
    ids = df.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("distinct_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"))
    main = df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(lv == ROOT).alias("root_rows"), F.count_if(lv == DIRECT).alias("direct_rows"), F.count_if(lv == NESTED).alias("nested_rows"),
        (F.count_if(F.coalesce(broken["bad_roots"], F.lit(False))) == 0).alias("roots_ok"), (F.count_if(F.coalesce((lv == DIRECT) & ~((F.col("in_reply_to_tweet_id") == F.col("root_tweet_id")) & (F.col("conversation_id") == F.col("root_tweet_id"))), F.lit(False))) == 0).alias("direct_ok"),
        F.count_if(text_or_blank(text) == "").alias("missing_text"),
    )
    return one_row(main, ids, replies_per_root(df).agg(F.count(F.lit(1)).alias("roots_with_replies")), orphan_replies(df).agg(F.count(F.lit(1)).alias("orphans")), reply_statistics(df))


def distribution(df: DataFrame, column: str, blank_name: str = "(kosong)") -> DataFrame:
    c = F.col(column).cast("string")
    return df.groupBy(F.when(blank(c), blank_name).otherwise(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def contract(df: DataFrame) -> DataFrame:
    """The audit with the list of broken rules and whether there are none."""
    a = audit(df)
    rules = {"empty": F.col("total_rows") == 0, "duplicates": F.col("duplicate_rows") > 0, "invalid_ids": F.col("invalid_ids") > 0, "scientific_ids": F.col("scientific_ids") > 0, "bad_roots": F.col("bad_roots") > 0, "bad_direct": F.col("bad_direct") > 0, "bad_nested": F.col("bad_nested") > 0, "orphans": F.col("orphans") > 0, "blank_text": F.col("blank_teks_komentar") > 0}
    broken = F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))
    return a.select(F.array_join(broken, ",").alias("broken"), (F.size(broken) == 0).alias("ok"))


def frame_check(df: DataFrame, text: str, label: str, valid: list[str], root: str) -> DataFrame:
    """Of a labelled frame: rows, duplicates beyond the first, invalid labels, empty texts, roots, validity."""
    lab = F.trim(text_or_blank(F.col(label)))
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct(text_or_blank(F.col("tweet_id")))).alias("n_duplicates"),
        F.array_sort(F.collect_set(F.when(~lab.isin(*valid), lab))).alias("invalid"), F.count_if(blank(F.col(text))).alias("n_empty"), F.count_distinct(root).alias("n_roots"),
    )
    return out.select("n_rows", "n_duplicates", F.array_join("invalid", "|").alias("invalid_labels"), "n_empty", "n_roots", ((F.col("n_duplicates") == 0) & (F.size("invalid") == 0) & (F.col("n_empty") == 0)).alias("is_valid"))


def repeated_texts(df: DataFrame) -> DataFrame:
    """Normalised texts that stand under more than one root."""
    t = collapse(F.lower(nfkc(F.col("teks_komentar"))))
    return df.select(t.alias("text"), normalize_id(F.col("root_tweet_id")).alias("root")).where("text <> '' and root <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("root").alias("n_roots")).where("n_roots > 1")


def file_digest(spark, path: str) -> DataFrame:
    """SHA-256, size, physical lines and byte-order mark of files, read as they are."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "ISO-8859-1")
    return raw.select(
        "path", "length", F.sha2("content", 256).alias("sha256"), (F.length(text) - F.length(F.regexp_replace(text, "\n", ""))).alias("newlines"), F.hex(F.substring("content", 1, 3)).eqNullSafe("EFBBBF").alias("bom"),
    )
