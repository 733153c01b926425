from datetime import datetime

from benang.operators import orphans as o

THREADS = "tweet_id string, root_tweet_id string, in_reply_to_tweet_id string, waktu_posting string, key string, refs int, missing_id string"
PILOT = "tweet_id string, root_tweet_id string, period string"
LOG = "tweet_id string, event_kind string, event_at timestamp, rows int"


def frames(spark, threads, pilot=(), log=()):
    return (
        spark.createDataFrame([(*r, "k", 1, "m") for r in threads], THREADS), spark.createDataFrame([(*r, "p") for r in pilot], PILOT),
        spark.createDataFrame([(i, k, datetime(2026, 1, d), 1) for i, k, d in log], LOG),
    )


ROWS = [
    ("1", "1", "", "2026-01-05T00:00:00Z"), ("2", "1", "1", "2026-01-05T00:00:00Z"), ("2", "1", "1", "2026-01-05T00:00:00Z"), ("3", "9", "8", "2026-02-05T00:00:00Z"), ("4", " ", "None", None),
    ("5", "5", "5", ""), ("6", "2", None, "2026-02-01T00:00:00Z"), (None, "1", "7", "x"),
]
LOG_ROWS = [("2", "removed", 1), ("2", "restored", 2), ("1", "Restored", 1), ("1", "REMOVED", 3), ("1", "REMOVED", 3), ("99", "removed", 1), (None, "removed", 1)]


def test_found(spark):
    t, p, l = frames(spark, ROWS, [("20", "1"), ("21", "404"), ("22", None)], LOG_ROWS)
    got = {tuple(r) for r in o.found(t, p, l).select("src_table", "tweet_id", "ref_field", "missing_id").collect()}
    assert got == {
        ("threads", "2", "root_tweet_id", "1"), ("threads", "2", "in_reply_to_tweet_id", "1"), ("threads", "3", "root_tweet_id", "9"), ("threads", "3", "in_reply_to_tweet_id", "8"), ("threads", None, "root_tweet_id", "1"), ("threads", None, "in_reply_to_tweet_id", "7"),
        ("pilot_raw", "20", "root_tweet_id", "1"), ("pilot_raw", "21", "root_tweet_id", "404"),
    }


def test_report_counts(spark):
    t, p, l = frames(spark, ROWS, [("21", "404")], LOG_ROWS)
    got = {(r.src_table, r.ref_field, r.period): (r.n_refs, r.n_missing) for r in o.report(t, p, l).collect()}
    assert got[("threads", "root_tweet_id", "2026-02")] == (1, 1) and got[("pilot_raw", "root_tweet_id", "")] == (1, 1)


def test_state_brought_up_to_date(spark):
    t, p, l = frames(spark, ROWS, [], LOG_ROWS)
    refs = o.references(t, "threads", ["root_tweet_id", "in_reply_to_tweet_id"])
    old = o.counts(o.reference_deltas(refs).unionByName(o.removal_deltas(l)))
    new = o.counts(o.existence_deltas(t))
    whole = o.counts(o.reference_deltas(refs).unionByName(o.removal_deltas(l)).unionByName(o.existence_deltas(t)))
    key = lambda df: {tuple(r) for r in o.orphan_keys(df).collect()}
    assert key(o.merge_counts(old, new)) == key(whole) != key(old)


def test_empty(spark):
    t, p, l = frames(spark, [])
    assert o.found(t, p, l).count() == 0 and o.report(t, p, l).count() == 0
