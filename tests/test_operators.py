import hashlib
import random

import pytest
from pyspark.sql import functions as F

from benang.functions import text as T
from benang.operators import lexicon, metrics, pilot, relations


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,want", [
    ("Hai @Budi cek HTTPS://x.test/a  ya", "hai user cek url ya"), ("mail a@b.test", "mail a@b.test"), ("@x @y", "user user"), (None, ""), ("  \u00a0 A\nB ", "a b"), ("www.a.test", "url"),
])
def test_cleanse(spark, text, want):
    assert one(spark, T.cleanse, text) == want


def test_cleanse_options(spark):
    o = T.Cleansing(lowercase=False, url_mode="remove", mention_mode="keep", keep_emoji=False, keep_punctuation=False)
    assert one(spark, lambda c: T.cleanse(c, o), "Oke! 😀 @a https://z.test anak-anak") == "Oke a anak-anak"
    with pytest.raises(ValueError):
        T.Cleansing(url_mode="other")


def test_token_replacement_needs_whole_tokens(spark):
    m = F.create_map(F.lit("gak"), F.lit("tidak"), F.lit("anak2"), F.lit("anak-anak"))
    assert one(spark, lambda c: T.replace_tokens(c, m), "Gak! gak-gak anak2-ku anak2.") == "tidak! gak-gak anak2-ku anak-anak."
    assert one(spark, lambda c: T.replace_words(c, m), "gak, gak  anak2") == "gak, tidak anak-anak"


def test_stopwords_keep_negations(spark):
    assert one(spark, T.drop_stopwords, "saya tidak ada di sini belum") == "tidak sini belum"


def test_search_query(spark):
    assert one(spark, T.search_query, "makan siang") == '"makan siang" -filter:links -filter:media'
    assert one(spark, T.search_query, "a OR b -filter:links") == "a OR b -filter:links -filter:media"


def test_top_two_takes_the_later_of_ties(spark):
    r = spark.createDataFrame([([0.4, 0.4, 0.2],), ([1.0],)], "p array<double>").select(*[c.alias(f"c{i}") for i, c in enumerate(T.top_two(F.col("p")))]).collect()
    assert (r[0].c0, r[0].c1, r[0].c2) == (1, 0.4, 0.0) and r[1].c2 == 0.0


@pytest.mark.parametrize("row,want", [
    (("1", "", "1", "1"), "Root_Tweet"), (("2", "1", "1", "1"), "Direct_Reply"), (("3", "2", "1", "1"), "Nested_Reply"), (("4", "1", "9", "1"), "Outside_Conversation"), (("5", "", "1", "1"), "Invalid_Reply"), (("6", "", "1", ""), "Outside_Conversation"),
])
def test_level(spark, row, want):
    df = spark.createDataFrame([row], "tweet_id string, in_reply_to_tweet_id string, conversation_id string, root_tweet_id string")
    assert relations.with_level(df).first()["level"] == want


def test_checked_context(spark):
    s = "tweet_id string, root_tweet_id string, teks_komentar string"
    roots, replies = spark.createDataFrame([("1", "1", "x"), ("1", "1", "y")], s), spark.createDataFrame([("2", "1", "z")], s)
    with pytest.raises(ValueError):
        relations.with_checked_context(replies, roots)
    with pytest.raises(ValueError):
        relations.with_checked_context(spark.createDataFrame([("2", "7", "z")], s), roots.limit(1))


def sequential(rows, total, cap, seed, strata):
    """The sample step by step, for comparison."""
    h = lambda *p: hashlib.md5("|".join((seed, *p)).encode()).hexdigest()
    chosen, used = [], {}
    quota = max(total // len(strata), 1)
    for stage in [*strata, pilot.REST]:
        pools = {}
        for t, r, s in rows:
            if (stage == pilot.REST or s == stage) and t not in chosen:
                pools.setdefault(r, []).append(t)
        for r in pools:
            pools[r].sort(key=lambda t: (h(stage, t), t))
        order = sorted(pools, key=lambda r: (h(stage, r), r))
        want = total - len(chosen) if stage == pilot.REST else min(quota, total - len(chosen))
        before = dict(used)
        if stage == pilot.REST:
            for r in order:
                for t in pools[r][: max(0, cap - before.get(r, 0))]:
                    if want > 0:
                        chosen.append(t)
                        used[r] = used.get(r, 0) + 1
                        want -= 1
        else:
            for k in range(cap):
                for r in order:
                    if want > 0 and k < len(pools[r]) and k < cap - before.get(r, 0):
                        chosen.append(pools[r][k])
                        used[r] = used.get(r, 0) + 1
                        want -= 1
    return chosen


@pytest.mark.parametrize("seed,total,cap", [(1, 20, 2), (2, 37, 3), (3, 500, 4)])
def test_pilot_sample_like_sequential(spark, seed, total, cap):
    r = random.Random(seed)
    strata = ["A", "B", "C"]
    rows = [(str(i), f"r{r.randrange(12)}", r.choice(strata)) for i in range(120)]
    df = spark.createDataFrame(rows, "tweet_id string, root_tweet_id string, stratum string")
    got = pilot.sample(df, total, cap, "s", strata).collect()
    assert sorted(x.tweet_id for x in got) == sorted(sequential(rows, total, cap, "s", strata))
    per = {}
    for x in got:
        per[x.root_tweet_id] = per.get(x.root_tweet_id, 0) + 1
    assert max(per.values()) <= cap and len(got) <= total


def test_pilot_rejects(spark):
    with pytest.raises(ValueError):
        pilot.sample(spark.createDataFrame([], "tweet_id string, root_tweet_id string, stratum string"), 0, 1)
    with pytest.raises(ValueError):
        pilot.checked_ids(spark.createDataFrame([("1",), ("1",)], "tweet_id string"))


def test_stratum(spark):
    for text, want in (("porsi kecil", "Mutu_Gizi_Signal"), ("audit dapur", "Tata_Kelola_Signal"), ("paket gizi", "Overlap"), ("halo", "No_Signal"), ("porsian", "No_Signal"), (None, "No_Signal")):
        assert one(spark, lambda c: pilot.stratum(c)[0], text) == want


def test_split_sizes_and_leakage(spark):
    df = spark.range(400).selectExpr("cast(id as string) as root_tweet_id")
    parts = pilot.group_split(df, "root_tweet_id", {"train": 0.7, "validation": 0.15, "test": 0.15})
    n = {r.part: r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 280, "validation": 60, "test": 60}
    assert pilot.leakage(parts, "root_tweet_id").count() == 0
    assert pilot.leakage(parts.unionByName(parts.withColumn("part", F.lit("test"))), "root_tweet_id").count() == 340


def test_metrics_by_hand(spark):
    pairs = [("A", "A"), ("A", "B"), ("B", "B"), ("B", "B")]
    df = spark.createDataFrame([(t, p, f"g{i % 2}") for i, (t, p) in enumerate(pairs)], "t string, p string, g string")
    cm = metrics.confusion(df, "t", "p")
    by = {r.label: r for r in metrics.class_metrics(cm, ["A", "B", "C"]).collect()}
    assert (by["A"].precision, by["A"].recall) == (1.0, 0.5) and by["C"].f1 == 0 and by["B"].support == 2
    o = metrics.overall(cm, ["A", "B", "C"]).first()
    assert o.accuracy == 0.75 and o.balanced_accuracy == 0.75 and abs(o.macro_recall - 0.5) < 1e-12
    k = metrics.kappa(df, "t", "p").first()
    assert k.agreement == 0.75 and abs(k.kappa - 0.5) < 1e-12
    b = metrics.bootstrap(df, "t", "p", "g", 50, labels=["A", "B", "C"]).first()
    assert b.low <= b.mean <= b.high
    perfect = spark.createDataFrame([("A", "A", "g")], "t string, p string, g string")
    assert abs(metrics.per_group_f1(perfect, "t", "p", "g", ["A", "B", "C"]).first().macro_f1 - 1 / 3) < 1e-12


def test_gates_include_limits(spark):
    df = spark.createDataFrame([(0.85, 0.79, None, 0.9, 0.85, 0)], "macro_f1 double, least_recall double, balanced_accuracy double, val_macro_f1 double, test_macro_f1 double, n_leaks int")
    r = metrics.gates(df).first()
    assert (r.macro_f1, r.class_recall, r.balanced_accuracy, r.zero_root_leakage) == ("pass", "fail", "not_evaluated", "pass")


def test_calibration_grid_like_rows(spark):
    r = random.Random(4)
    rows = [(r.choice("AB"), r.choice("AB"), r.uniform(0.3, 1), r.uniform(0, 0.4)) for _ in range(200)]
    grid = metrics.calibration_grid(spark.createDataFrame(rows, "t string, p string, c double, m double"), "t", "p", "c", "m", ["A", "B"]).collect()
    for g in grid:
        kept = [x for x in rows if x[2] >= g.confidence_threshold - 1e-9 and x[3] >= g.margin_threshold - 1e-9]
        assert abs(g.coverage - len(kept) / 200) < 1e-9
    assert sum(g.best for g in grid) == 1


def test_abstention(spark):
    for c, m, want in ((0.9, 0.3, "ACCEPTED"), (0.4, 0.3, "NEEDS_REVIEW"), (0.7, 0.05, "NEEDS_REVIEW"), (0.6, 0.15, "ACCEPTED")):
        assert spark.range(1).select(metrics.abstention(F.lit(c), F.lit(m)).alias("o")).first()["o"] == want


def test_dictionary(spark):
    s = "slang string, kata_baku string, frekuensi bigint"
    df = spark.createDataFrame([("Gak", "tidak", 5), ("gak ", "tak", 2), ("ya", "ya", 1), ("", "x", 1), (None, None, None)], s)
    assert {r.slang: r.kata_baku for r in lexicon.valid_mapping(df).collect()} == {"gak": "tidak"}
    assert sorted(r.problem for r in lexicon.mapping_rows(df).where("problem is not null").collect()) == ["duplicate", "empty", "empty", "identity"]
    up = lexicon.upsert(df, spark.createDataFrame([("gak", "enggak", 1), ("bgt", "banget", 1)], s)).collect()
    assert [(r.slang, r.kata_baku) for r in up] == [("bgt", "banget"), ("gak", "enggak")]


def test_elongations_and_canonical(spark):
    vocab = spark.createDataFrame([("enaaak", 3), ("enak", 9), ("maaf", 2)], "token string, n bigint")
    bases = spark.createDataFrame([("enak", "enak"), ("maf", "maf")], "word string, target string")
    got = {r.slang: r.kata_baku for r in lexicon.elongations(vocab, bases).collect()}
    assert got == {"enaaak": "enak", "maaf": "maf"}
    assert one(spark, lambda c: lexicon.canonical(c, {"a": "b", "b": "c"}), "A  x") == "c x"
    assert one(spark, lambda c: lexicon.canonical(c, {"a": "b", "b": "a"}), "a") is None


def test_seed_ids(spark):
    df = spark.createDataFrame([(1, "123456, https://h.test/u/status/9876543?x=1"), (2, "123456;12")], "o int, v string")
    got = {(r.seed_id, r.valid) for r in relations.seed_ids(df, "v", "o").collect()}
    assert got == {("123456", True), ("9876543", True), ("12", False)}


def test_import_counters(spark):
    cols = ["tweet_id", "created_at", "username", "display_name", "followers_count", "content", "lang", "like_count", "retweet_count", "reply_count", "quote_count", "view_count", "is_retweet", "step", "keyword_matched", "root_tweet_id", "url"]
    base = dict.fromkeys(cols, "") | {"content": "teks yang cukup", "step": "1_root", "is_retweet": "0"}
    rows = [base | {"tweet_id": "1000001", "reply_count": "100"}, base | {"tweet_id": "1000002", "reply_count": "x"}, base | {"tweet_id": "1000003", "step": "2_reply"}, base | {"tweet_id": "1000004", "is_retweet": "True"}]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"{c} string" for c in cols))
    c = relations.import_counts(relations.import_legacy(df, spark.createDataFrame([], "tweet_id string"), 100)).first()
    assert (c.total, c.imported, c.rejected, c.duplicate, c.eligible) == (4, 2, 2, 0, 1)


def test_hash_positions(spark):
    rows = [(str(i), "hot" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, g string")
    got = pilot.hash_positions(df, ["g"], F.md5("k"), "k").collect()
    for g in ("hot", None):
        order = sorted((hashlib.md5(k.encode()).hexdigest(), k) for k, x in rows if x == g)
        assert {r.k: r.position for r in got if r.g == g} == {k: i + 1 for i, (_, k) in enumerate(order)}


def test_escalating_caps(spark):
    rows = [(f"{s}{i}", f"r{i % 2}", s) for s in "AB" for i in range(6)]
    df = spark.createDataFrame(rows, "tweet_id string, root_tweet_id string, stratum string")
    got = pilot.escalating_sample(df, 3, (1, 2, 3, 100), strata=["A", "B"]).collect()
    assert len(got) == 6 and {r.cap for r in got} == {3}
    with pytest.raises(ValueError):
        pilot.escalating_sample(df, 7, (1, 100), strata=["A", "B"])


def test_prepare_needs_enough_rows(spark):
    s = "tweet_id string, root_tweet_id string, teks_komentar string, hierarki_komentar string"
    df = spark.createDataFrame([("r", "r", "akar", "Root_Tweet"), *[(str(i), "r", "porsi kecil", "Direct_Reply") for i in range(4)]], s)
    got = pilot.prepare(df, 3, 5, "1.0")
    assert got.count() == 3 and "stratum" not in got.columns and {r.teks_root for r in got.collect()} == {"akar"}
    with pytest.raises(ValueError):
        pilot.prepare(df, 5, 5, "1.0")


def test_short_strata_and_pilots_have_a_result(spark):
    rows = [(f"{s}{i}", f"r{i % 2}", s) for s, n in (("A", 6), ("B", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "tweet_id string, root_tweet_id string, stratum string")
    got = pilot.escalating_sample(df, 4, (1, 100), strata=["A", "B"], partial=True).collect()
    assert sorted(r.stratum for r in got) == ["A"] * 4 + ["B"] * 2 and {r.cap for r in got} == {100}
    s = "tweet_id string, root_tweet_id string, teks_komentar string, hierarki_komentar string"
    df = spark.createDataFrame([("r", "r", "akar", "Root_Tweet"), *[(str(i), "r", "porsi kecil", "Direct_Reply") for i in range(9)]], s)
    assert pilot.prepare(df, 300, 5, "1.0", partial=True).count() == 5


def test_samples_have_the_survey_sizes(spark, data):
    from benang.plans import reference

    q, sql = reference.queries(), reference.oracle_sql()
    assert q["o6_shuffle_all"](spark, data).count() == spark.read.parquet(f"{data}/pilot_raw.parquet").select("tweet_id").distinct().count()
    assert "LIMIT" not in sql["o6_shuffle_all"] and "range(1000)" in sql["m2_bootstrap_1000"]
    got = q["w3_escalating_sample"](spark, data)
    per = {r["stage"]: r["count"] for r in got.groupBy("stage").count().collect()}
    assert "Overlap" in per and max(per.values()) == 60, per
    assert 60 < q["w5_prepare_pilot"](spark, data).count() <= 300


def test_any_scorer(spark):
    from benang.operators import ml

    df = spark.createDataFrame([("1", "ya"), ("2", None)], "tweet_id string, t string")
    got = {r.tweet_id: (r.prediction, r.status) for r in ml.score_with(df, "t", lambda: lambda texts: [[0.9, 0.1] if t else [0.5, 0.5] for t in texts], ["A", "B"]).collect()}
    assert got == {"1": ("A", "ACCEPTED"), "2": ("A", "NEEDS_REVIEW")}


def test_experiments(spark):
    from benang.operators import ml

    rows = [(f"{c}{i}", f"{w} {w} kata{i % 3}", c, w) for c, w in (("A", "enak gurih"), ("B", "audit dana"), ("C", "paket tumpah")) for i in range(8)]
    df = spark.createDataFrame(rows, "tweet_id string, text string, label string, root_text string")
    got = {r.experiment: r.macro_f1 for r in ml.run_experiments(df, df, ["E2"], ["A", "B", "C"]).collect()}
    assert set(got) == {"E2"}
    assert set(ml.REGISTRY) == {"E0", "E1", "E2", "E3", "E4", "E5", "E6", "Audit"}


def test_queue_seeds(spark):
    seeds = spark.createDataFrame([("123456", True), ("12", False), ("999999", True)], "seed_id string, valid boolean")
    queue = spark.createDataFrame([("999999", "k")], "tweet_id string, keyword_matched string")
    assert {tuple(r) for r in relations.queue_seeds(seeds, queue).collect()} == {("999999", "k"), ("123456", "MANUAL_SEED")}


def test_reports_and_rules_keep_all(spark, tmp_path):
    from benang.sources import files

    with pytest.raises(ValueError):
        files.write_report(spark.range(1001), str(tmp_path / "r.json"))
    (tmp_path / "rules.yaml").write_text("# note:\nA:\n  - \'satu # dua\'  # kata\n  - tiga\n_B:\n  - empat\n")
    assert files.read_rules(str(tmp_path / "rules.yaml")) == {"A": ["satu # dua", "tiga"]}


def test_statistics_are_of_direct_replies(spark):
    from benang.operators import audit, relations

    rows = [("1", "1", "1", "", "Root_Tweet", "a"), ("2", "2", "2", "", "Root_Tweet", "a"), ("3", "1", "1", "1", "Direct_Reply", "b"), ("4", "1", "1", "1", "Direct_Reply", ""), ("5", "1", "1", "3", "Nested_Reply", "c"), ("6", "9", "9", "9", "Direct_Reply", "d"), ("7", "9", "9", "6", "Nested_Reply", "e")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "tweet_id string, root_tweet_id string, conversation_id string, in_reply_to_tweet_id string, hierarki_komentar string, teks_komentar string, n int")
    a = audit.dataset_audit(df).first()
    assert (a.total_rows, a.root_rows, a.direct_rows, a.nested_rows, a.roots_with_replies, a.orphans, a.missing_text, a.max) == (7, 2, 3, 2, 2, 1, 1, 2.0)
    assert a.roots_ok and a.direct_ok and relations.orphan_replies(df).count() == 1


def test_topic_and_domain_terms(spark):
    from benang.functions import text as T

    df = spark.createDataFrame([("Program MBG baik",), ("smbg",), ("makan \n bergizi",), ("makan gratis anak sekolah",), ("makan gratis",)], "t string")
    assert [r[0] for r in df.select(T.relevant(df.t)).collect()] == [True, False, True, True, False]
    assert spark.createDataFrame([("ini mbg untuk saya",)], "t string").select(T.drop_stopwords(F.col("t"))).first()[0] == "mbg"


def test_classifiers_as_registered(spark):
    from benang.operators import ml

    assert ml.ALPHAS == (0.01, 0.03, 0.1, 0.3, 0.5, 1.0, 2.0)
    rows = [(str(i), ["A", "B", "C"][i % 3], ["sayur enak gizi", "dana audit vendor", "paket telat kirim"][i % 3], "akar") for i in range(30)]
    df = spark.createDataFrame(rows, "tweet_id string, label string, text string, root_text string")
    got = {(r.experiment, r.alpha): r.macro_f1 for r in ml.run_experiments(df, df, ["E0", "E3", "E5", "E6", "Audit"], ["A", "B", "C"], (0.1, 1.0)).collect()}
    assert set(got) == {("E0", None), ("Audit", None), *[(e, a) for e in ("E3", "E5", "E6") for a in (0.1, 1.0)]}
    assert got["E0", None] == pytest.approx(1 / 6) and all(v == 1.0 for k, v in got.items() if k[0] != "E0")
    terms = ml.characters("c", "text")[0].transform(spark.createDataFrame([("ab xyz",)], "text string")).first().c_terms
    assert sorted(terms) == sorted([" ab", "ab ", " ab ", " xy", "xyz", "yz ", " xyz", "xyz ", " xyz "])
    shares = {r.prediction: r.n for r in ml.stratified(df.unionByName(df)).groupBy("prediction").count().withColumnRenamed("count", "n").collect()}
    assert sum(shares.values()) == 60 and set(shares) <= {"A", "B", "C"}


def test_scratch_refuses_local_folders_on_clusters(spark, monkeypatch):
    from benang import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    class No:
                        def isDefined(self):
                            return False
                    return No()

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Fake())
