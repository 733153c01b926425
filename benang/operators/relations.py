"""Records and their relations: projections to the canonical record, hierarchy, context and difference joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benang.functions.ids import normalize_id
from benang.functions.text import RETWEET_FLAGS, SEED, meaningful, text_or_blank

# fixed values: the record contract
CORE = ["tweet_id", "root_tweet_id", "conversation_id", "in_reply_to_tweet_id", "waktu_posting", "username", "teks_komentar", "jumlah_likes", "jumlah_retweet", "sumber_akuisisi", "hierarki_komentar"]
FIELDS = CORE + ["display_name", "followers_count", "bahasa", "jumlah_reply", "jumlah_quote", "jumlah_view", "keyword_matched", "url"]
COUNTERS = ["jumlah_likes", "jumlah_retweet", "followers_count", "jumlah_reply", "jumlah_quote", "jumlah_view"]
KEYWORD, REPLY = "KEYWORD_SEARCH", "REPLY_TWEET_ID"
ROOT, DIRECT, NESTED, OUTSIDE, INVALID = "Root_Tweet", "Direct_Reply", "Nested_Reply", "Outside_Conversation", "Invalid_Reply"


def normalized(df: DataFrame) -> DataFrame:
    """Ids trimmed with '' for blank, counters with 0 for null."""
    ids = {c: normalize_id(F.col(c)) for c in CORE[:4] if c in df.columns}
    counts = {c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)) for c in COUNTERS if c in df.columns}
    return df.withColumns(ids | counts)


def level(tweet: Column, parent: Column, conversation: Column, root: Column) -> Column:
    """The place of a record below a root; the order of the tests matters."""
    return (
        F.when((root == "") | (conversation != root), OUTSIDE).when(tweet == root, ROOT).when(parent == "", INVALID).when(parent == root, DIRECT).otherwise(NESTED)
    )


def with_level(df: DataFrame) -> DataFrame:
    return normalized(df).withColumn("level", level(F.col("tweet_id"), F.col("in_reply_to_tweet_id"), F.col("conversation_id"), F.col("root_tweet_id")))


def is_root(df_text: Column, tweet: Column, conversation: Column, parent: Column, retweet: Column | None = None) -> Column:
    flag = F.lit(False) if retweet is None else retweet
    return (tweet != "") & (conversation == tweet) & (parent == "") & ~flag & ~F.ltrim(text_or_blank(df_text)).startswith("RT @")


def build_rows(df: DataFrame) -> DataFrame:
    """Canonical rows with ``reject``: null, or why the relation metadata do not suit the source."""
    n = with_level(df)
    kw = F.when((F.col("conversation_id") != F.col("tweet_id")) | (F.col("in_reply_to_tweet_id") != ""), "not_a_root")
    rp = F.when((F.col("root_tweet_id") == "") | (F.col("conversation_id") == "") | (F.col("in_reply_to_tweet_id") == ""), "missing_relation").when(~F.col("level").isin(DIRECT, NESTED), "outside")
    source = F.trim(text_or_blank(F.col("sumber_akuisisi")))
    reject = F.when(F.col("tweet_id") == "", "no_id").when(source == KEYWORD, kw).when(source == REPLY, rp).otherwise("unknown_source")
    return n.withColumn("reject", reject).withColumn("url", F.when(text_or_blank(F.col("url")) != "", F.col("url")).when(text_or_blank(F.col("username")) != "", F.concat(F.lit("https://linimasa.example/"), "username", F.lit("/status/"), "tweet_id")).otherwise(""))


def legacy_integer(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0))


def legacy_rows(df: DataFrame) -> DataFrame:
    """Legacy rows in the canonical columns, with ``reject``."""
    tweet = normalize_id(F.col("tweet_id"))
    flag = F.lower(F.trim(F.coalesce("is_retweet", F.lit("0"))))
    reject = (
        F.when(~tweet.rlike("^[0-9]+$"), "bad_id").when((F.trim(text_or_blank(F.col("step"))) != "1_root") | (normalize_id(F.col("root_tweet_id")) != ""), "not_a_root")
        .when(flag.isin(*RETWEET_FLAGS), "retweet").when(~meaningful(F.col("content")), "no_text")
    )
    text = lambda c: text_or_blank(F.col(c))
    return df.select(
        tweet.alias("tweet_id"), tweet.alias("root_tweet_id"), tweet.alias("conversation_id"), F.lit("").alias("in_reply_to_tweet_id"), text("created_at").alias("waktu_posting"), text("username").alias("username"),
        text("content").alias("teks_komentar"), legacy_integer(F.col("like_count")).alias("jumlah_likes"), legacy_integer(F.col("retweet_count")).alias("jumlah_retweet"), F.lit(KEYWORD).alias("sumber_akuisisi"),
        F.lit(ROOT).alias("hierarki_komentar"), text("display_name").alias("display_name"), legacy_integer(F.col("followers_count")).alias("followers_count"), text("lang").alias("bahasa"),
        legacy_integer(F.col("reply_count")).alias("jumlah_reply"), legacy_integer(F.col("quote_count")).alias("jumlah_quote"), legacy_integer(F.col("view_count")).alias("jumlah_view"), text("keyword_matched").alias("keyword_matched"), text("url").alias("url"), reject.alias("reject"),
    )


def import_legacy(legacy: DataFrame, known: DataFrame, least_replies: int) -> DataFrame:
    """Legacy rows tagged imported, duplicate or rejected, with ``eligible`` for the reply queue. Of equal ids in the
    batch the first by (waktu_posting, text) is imported."""
    rows = legacy_rows(legacy)
    seen = known.select(normalize_id(F.col("tweet_id")).alias("tweet_id"), F.lit(True).alias("seen")).distinct()
    order = W.partitionBy("tweet_id", F.col("reject").isNull()).orderBy("waktu_posting", "teks_komentar", "jumlah_likes")
    tagged = rows.withColumn("rn", F.row_number().over(order)).join(seen, "tweet_id", "left")
    status = F.when(F.col("reject").isNotNull(), "rejected").when(F.coalesce("seen", F.lit(False)) | (F.col("rn") > 1), "duplicate").otherwise("imported")
    return tagged.withColumn("status", status).withColumn("eligible", (F.col("status") == "imported") & (F.col("jumlah_reply") >= least_replies)).drop("rn", "seen")


def import_counts(tagged: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return tagged.agg(F.count(F.lit(1)).alias("total"), is_("imported").alias("imported"), is_("duplicate").alias("duplicate"), is_("rejected").alias("rejected"), F.count_if("eligible").alias("eligible"))


def first_rows(df: DataFrame, key: str = "tweet_id", order: tuple[str, ...] = ("captured_at",)) -> DataFrame:
    """One row per key: the least by ``order`` (then by all columns, so that ties are settled)."""
    rest = [c for c in df.columns if c not in order]
    best = df.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def roots_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("hierarki_komentar") == ROOT)


def direct_replies(df: DataFrame) -> DataFrame:
    return df.where(F.col("hierarki_komentar") == DIRECT)


def with_context(replies: DataFrame, roots: DataFrame) -> DataFrame:
    """Replies with the text of their root, null where there is none."""
    context = roots.select(F.col("tweet_id").alias("root_tweet_id"), F.col("teks_komentar").alias("teks_root"))
    return replies.join(context, "root_tweet_id", "left")


def ambiguous_roots(roots: DataFrame) -> DataFrame:
    return roots.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_checked_context(replies: DataFrame, roots: DataFrame) -> DataFrame:
    """Like with_context; raises where a root id is not unique or a reply lacks a filled context."""
    if not ambiguous_roots(roots).isEmpty():
        raise ValueError("root ids are not unique")
    out = with_context(replies, roots)
    if not out.where(F.trim(F.coalesce("teks_root", F.lit(""))) == "").isEmpty():
        raise ValueError("replies without root context")
    return out


def orphan_replies(df: DataFrame) -> DataFrame:
    """Direct replies whose root id is no root row's id."""
    return direct_replies(df).join(roots_of(df).select(F.col("tweet_id").alias("root_tweet_id")).distinct(), "root_tweet_id", "left_anti")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on one side only, and on which side."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "left_only").otherwise("right_only").alias("side"))


def reconcile(data: DataFrame, state: DataFrame, queue: DataFrame, least_replies: int) -> DataFrame:
    """Counters of making a state follow the data: ids removed and added, queue entries recovered, invalid rows, total."""
    required = [F.trim(text_or_blank(F.col(c))) != "" for c in ("tweet_id", "teks_komentar", "sumber_akuisisi", "hierarki_komentar")]
    ok = required[0] & required[1] & required[2] & required[3]
    valid = data.where(ok)
    diff = difference(valid, state, "tweet_id")
    queued = valid.where((F.col("hierarki_komentar") == ROOT) & (F.coalesce("jumlah_reply", F.lit(0)) >= least_replies)).select("tweet_id").distinct().join(queue, "tweet_id", "left_anti")
    return one_row(
        diff.agg(F.count_if(F.col("side") == "right_only").alias("removed"), F.count_if(F.col("side") == "left_only").alias("added")),
        queued.agg(F.count(F.lit(1)).alias("recovered")), data.agg(F.count_if(~ok).alias("invalid")), valid.agg(F.count_distinct("tweet_id").alias("total")),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row results side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def pending_roots(queue: DataFrame, state: DataFrame, nested: bool) -> DataFrame:
    """Queue entries not completed; direct_exhausted completes a root only when nested replies are not wanted."""
    done = ["all_exhausted", "invalid_root"] + ([] if nested else ["direct_exhausted"])
    return queue.join(state.where(F.col("status").isin(*done)).select("tweet_id"), "tweet_id", "left_anti")


def seed_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct ids from free text of ids and status addresses, in order of first mention; bad tokens with valid = false."""
    tokens = df.select(F.col(order).alias("o"), F.posexplode(F.split(F.trim(column), r"[\s,;]+")).alias("pos", "token")).where("token <> ''")
    got = F.regexp_extract("token", SEED, 1)
    ids = tokens.withColumn("seed_id", F.when(got != "", got).otherwise(F.col("token")))
    first = ids.groupBy("seed_id").agg(F.min(F.struct("o", "pos")).alias("first"))
    return first.select("seed_id", F.col("seed_id").rlike("^[0-9]{6,}$").alias("valid"), F.col("first.o").alias("first_row"), F.col("first.pos").alias("first_pos"))


def queue_seeds(seeds: DataFrame, queue: DataFrame, label: str = "MANUAL_SEED") -> DataFrame:
    """The reply queue with valid seed ids added that it does not hold; ids already fetched do not matter."""
    new = seeds.where("valid").select(F.col("seed_id").alias("tweet_id")).join(queue.select("tweet_id"), "tweet_id", "left_anti")
    return queue.select("tweet_id", "keyword_matched").unionByName(new.withColumn("keyword_matched", F.lit(label)))
