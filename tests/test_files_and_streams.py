import json
import os

import pytest
from pyspark.sql import functions as F

from benang.operators.relations import FIELDS
from benang.sources import files
from benang.streaming import threads as streams

TEXTS = ['dua\nbaris, "kutip" 😀', " tepi ", "NA", "", "=1+1", "null"]


def canonical(spark, texts=TEXTS):
    rows = [tuple(str(100000 + i) if c == "tweet_id" else t if c == "teks_komentar" else "Root_Tweet" if c == "hierarki_komentar" else "KEYWORD_SEARCH" if c == "sumber_akuisisi" else "7" if c == "jumlah_reply" else "" for c in FIELDS) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FIELDS))


def test_csv_round_trip(spark, tmp_path):
    df = canonical(spark)
    files.write_csv(df, str(tmp_path / "a"))
    back = files.read_csv(spark, str(tmp_path / "a"), FIELDS, strict=True)
    assert sorted(r.teks_komentar for r in back.collect()) == sorted(TEXTS)
    with pytest.raises(Exception):
        files.write_csv(df, str(tmp_path / "a"))


def test_single_file_with_mark(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    files.write_single_csv(canonical(spark), path)
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\xef\xbb\xbf") == 1
    with pytest.raises(FileExistsError):
        files.write_single_csv(canonical(spark), path)
    assert files.header(spark, path) == FIELDS and os.listdir(tmp_path) == ["one.csv"]


def test_durable_state(spark, tmp_path):
    files.write_csv(canonical(spark), str(tmp_path / "a"))
    ids, invalid, queue = files.durable(spark, str(tmp_path / "a"), 5)
    assert (ids.count(), invalid.first()[0], queue.count()) == (5, 1, 5)
    files.write_csv(canonical(spark).select(*reversed(FIELDS)), str(tmp_path / "b"))
    with pytest.raises(files.ContractError):
        files.durable(spark, str(tmp_path / "b"), 5)


def test_checkpoint(spark, tmp_path):
    path = str(tmp_path / "state.json")
    files.write_state({"seen_ids": ["2", "1", "1", " none "], "done_queries": [], "step2_queue": {"1": "x", "": "y"}, "root_status": {}, "output_file": "a", "saved_at": ""}, path)
    s = files.read_state(spark, path).first()
    assert s.seen_ids == ["1", "2"] and s.step2_queue == {"1": "x"}
    json.dump({"version": 1}, open(path, "w"))
    with pytest.raises(files.ContractError):
        files.read_state(spark, path)
    assert files.read_state_or_error(spark, path)[1] and files.read_state_or_error(spark, str(tmp_path / "no"))[0] is None


def test_lines_rules_mapping(spark, tmp_path):
    (tmp_path / "k.txt").write_text("#tagar\n\n  dua kata \n")
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "k.txt")).collect()] == ["#tagar", "dua kata"]
    (tmp_path / "r.yaml").write_text("# note\nA:\n  keywords:\n    - x\n    - 'y z'\nB:\n  - w\n_c:\n  - n\n")
    assert files.read_rules(str(tmp_path / "r.yaml")) == {"A": ["x", "y z"], "B": ["w"]} and files.read_rules("/nowhere") == {}
    good = spark.createDataFrame([("Gak", "tidak, kah", 3), ("bgt", "banget", 1)], "slang string, kata_baku string, frekuensi bigint")
    files.write_mapping(good, str(tmp_path / "m"))
    assert {(r.slang, r.kata_baku, r.frekuensi) for r in files.read_mapping(spark, str(tmp_path / "m")).collect()} == {("gak", "tidak, kah", 3), ("bgt", "banget", 1)}
    with pytest.raises(files.ContractError):
        files.write_mapping(good.unionByName(good), str(tmp_path / "n"))
    assert not (tmp_path / "n").exists()


def test_stream_restart_adds_nothing_twice(spark, tmp_path):
    schema = "tweet_id string, v int"
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([("1", 1), ("2", 1), ("2", 2)], schema).coalesce(1).write.parquet(src)
    streams.ingest(spark, src, schema, out, mark)
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("2", 3), ("3", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    streams.ingest(spark, src, schema, out, mark)
    streams.ingest(spark, src, schema, out, mark)
    assert sorted(r.tweet_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_states_merge(spark):
    s = "root_tweet_id string, status string"
    got = streams.merge_states(spark.createDataFrame([("1", "pending"), ("2", "failed")], s), spark.createDataFrame([("1", "all_exhausted")], s))
    assert {tuple(r) for r in got.collect()} == {("1", "all_exhausted"), ("2", "failed")}


def test_quota_is_exact(spark):
    assert streams.quota(spark.range(50).select(F.col("id").alias("k")), 7, ["k"]).count() == 7


def test_lexicons_and_pilot_export(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("informal\tformal\textra\ngak\ttidak\tx\n")
    (tmp_path / "b.csv").write_text("slang,formal,n\nbgt,\"banget, sekali\",2\n")
    got = files.read_lexicons(spark, str(tmp_path / "a.tsv"), str(tmp_path / "b.csv"), ["informal", "formal", "extra"], ["slang", "formal", "n"])
    assert {tuple(r) for r in got.collect()} == {("gak", "tidak", "tsv"), ("bgt", "banget, sekali", "csv")}
    df = spark.createDataFrame([("1", "x")], "tweet_id string, stratum string")
    files.export_pilot(df.select("tweet_id"), df, df.agg(F.count("*").alias("n")), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["audit.json", "coordinator_sampling.csv", "pilot.csv"] and json.load(open(tmp_path / "out/audit.json")) == [{"n": 1}]
    with pytest.raises(FileExistsError):
        files.export_pilot(df, df, df, str(tmp_path / "out"))


def test_latest_file_lines_report(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("x")
        os.utime(tmp_path / f"{name}.csv", (1_700_000_000, 1_700_000_000 + (name == "a")))
    assert files.latest_file(spark, str(tmp_path)).first().path.endswith("a.csv")
    files.write_lines(spark.createDataFrame([("satu",), ("#dua",)], "k string"), "k", str(tmp_path / "k"))
    assert {r.value for r in files.read_lines(spark, str(tmp_path / "k")).collect()} == {"satu", "#dua"}


def test_replies_wait_for_their_root(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "tweet_id string, root_tweet_id string, conversation_id string, in_reply_to_tweet_id string, teks_komentar string"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    put([("2", "1", "1", "1", "balasan"), ("9", "8", "8", "8", "tanpa akar")])
    put([("1", "1", "1", "", "akar"), ("3", "1", "1", "2", "balasan")])
    put([("4", "1", "1", "1", "balasan"), ("2", "1", "1", "1", "balasan")])
    got = sorted(r.tweet_id for r in streams.stream_deferred(spark, src, schema).collect())
    assert got == ["2", "3", "4"]


def test_deferred_stream_is_cheap_by_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "tweet_id string, root_tweet_id string, conversation_id string, in_reply_to_tweet_id string, teks_komentar string"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    put([("2", "1", "1", " 1", "balasan"), ("2", "1", "1", "1", "balasan"), ("5", "", "", "1", "tanpa benang"), ("7", "6", "6", "6", "akar salah")])
    put([(" 1", "1", "1", "None", "akar"), ("6", "6", "6", None, "RT @a akar"), ("3", "1", "1", "2", "balasan")])
    put([("1", "1", "1", "", "akar"), ("2", "1", "1", "1", "balasan"), ("4", "1", "1", "1", "balasan"), ("9", "8", "8", "8", "tanpa akar")])
    before, tasks = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext._jsc.sc().taskScheduler().nextTaskId
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        started = tasks()
        got = sorted((r.tweet_id, r.root_tweet_id) for r in streams.stream_deferred(spark, src, schema).collect())
        started = tasks() - started
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [("2", "1"), ("3", "1"), ("4", "1")]
    assert started < 200, started  # three batches; a state store has a task for each shuffle partition in each of them
