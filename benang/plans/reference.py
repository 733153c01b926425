"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benang.functions import ids as I
from benang.functions import text as T
from benang.operators import audit, lexicon, metrics, ml, pilot, relations, summary
from benang.session import Scratch
from benang.sources import files
from benang.sources.tables import table
from benang.streaming import threads as streams

CATS = metrics.LABELS
#: a topic given as a parameter: words of the test data
DATA_TOPIC = r"(?i)(makan siang|makan gratis|gizi|dapur|menu|porsi|sekolah)"


# helpers over the tables -------------------------------------------------------------------------------------------

def clean_label(c):
    """The category a label names apart from case and separators, the letters in lower case otherwise."""
    low = F.lower(F.regexp_replace(T.text_or_blank(c), r"[^\p{L}]", ""))
    out = low
    for name in CATS:
        out = F.when(low == name.lower().replace("_", ""), name).otherwise(out)
    return out


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pilot posts with cleaned labels of the two slots."""
    p = table(spark, d, "pilot_raw")
    return p.select("tweet_id", "root_tweet_id", "teks_root", "teks_komentar", clean_label(F.col("annotator_1")).alias("a1"), clean_label(F.col("annotator_2")).alias("a2"), "annotator_1", "annotator_2", "adjudicated_label", "kategori_utama", "subkategori_primer", "kategori_sekunder", "annotation_status").distinct()


def posts(spark: SparkSession, d: str) -> DataFrame:
    """One row per post: the earliest fetch, ids normalised."""
    return relations.first_rows(relations.normalized(table(spark, d, "threads")), "tweet_id", ("captured_at", "root_tweet_id", "jumlah_likes"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Three made-up class probabilities per post, from its counters."""
    t = posts(spark, d).select("tweet_id", "root_tweet_id", *[(F.col(c) + 1.0).alias(c) for c in ("jumlah_likes", "jumlah_retweet", "jumlah_reply")])
    s = F.col("jumlah_likes") + F.col("jumlah_retweet") + F.col("jumlah_reply")
    return t.withColumn("p", F.array(*[F.col(c) / s for c in ("jumlah_likes", "jumlah_retweet", "jumlah_reply")]))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Pilot posts with the second slot as truth, the first as prediction, and confidence and margin by their texts' length."""
    p = labelled(spark, d)
    n = F.length(T.text_or_blank(F.col("teks_komentar")))
    return p.where(F.col("a1").isin(*CATS) & F.col("a2").isin(*CATS)).select("tweet_id", "root_tweet_id", F.col("a2").alias("true"), F.col("a1").alias("pred"), ((n % 61) / 100.0 + 0.39).alias("confidence"), ((n % 31) / 100.0).alias("margin"))


def slang(spark: SparkSession, d: str):
    return lexicon.lookup(table(spark, d, "slang_map"))


def text_query(make):
    return lambda s, d: table(s, d, "threads").select("tweet_id", "captured_at", make(F.col("teks_komentar")).alias("out")).drop("captured_at")


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    t = table(spark, d, "threads").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in relations.FIELDS])
    path = f"{scratch.base}/csv"
    files.write_csv(t, path)
    return files.read_csv(spark, path, relations.FIELDS, strict=True)


def durable_scan(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    t = table(spark, d, "threads").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in relations.FIELDS])
    path = f"{scratch.base}/csv"
    files.write_csv(t, path)
    ids, invalid, queue = files.durable(spark, path, 3)
    return relations.one_row(ids.agg(F.count(F.lit(1)).alias("n_ids")), invalid, queue.agg(F.count(F.lit(1)).alias("n_queue")))


def id_scan(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids of a CSV, and whether its header keeps the contract."""
    path = f"{Scratch(spark).base}/csv"
    files.write_csv(table(spark, d, "threads").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in relations.FIELDS]), path)
    files.check_header(spark, path)
    return files.read_csv(spark, path, relations.FIELDS, strict=True).select(I.normalize_id(F.col("tweet_id")).alias("tweet_id")).where("tweet_id <> ''").distinct()


def lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Keywords written as lines and read again: trimmed, blank ones left out."""
    path = f"{Scratch(spark).base}/lines"
    files.write_lines(table(spark, d, "threads").select("keyword_matched").distinct().where("keyword_matched is not null"), "keyword_matched", path)
    return files.read_lines(spark, path).distinct()


def mapping_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(spark).base}/mapping"
    files.write_mapping(lexicon.valid_mapping(table(spark, d, "slang_map")), path)
    return files.read_mapping(spark, path)


def lexicons(spark: SparkSession, d: str) -> DataFrame:
    """Two dictionaries of different form, written and read as one."""
    base = Scratch(spark).base
    words = lexicon.valid_mapping(table(spark, d, "slang_map"))
    words.select(F.col("slang").alias("a"), F.col("kata_baku").alias("b"), F.lit("x").alias("c")).write.option("header", True).option("sep", "\t").option("quoteAll", True).option("escape", '"').csv(f"{base}/tsv")
    files.write_csv(words.select("slang", "kata_baku"), f"{base}/csv")
    return files.read_lexicons(spark, f"{base}/tsv", f"{base}/csv", ["a", "b", "c"], ["slang", "kata_baku"])


def fit_predict(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        data = labelled(spark, d).where(F.col("a1").isin(*CATS)).select("tweet_id", "root_tweet_id", T.model_text(F.col("teks_komentar")).alias("text"), T.model_text(F.col("teks_root")).alias("root_text"), F.col("a1").alias("label"))
        parts = data.join(pilot.group_split(data, "root_tweet_id", {"train": 0.8, "test": 0.2}), "root_tweet_id")
        parts = Scratch(spark).save(parts)
        model = ml.build(name).fit(parts.where("part = 'train'"))
        return model.transform(parts.where("part = 'test'")).select("tweet_id", "label", F.element_at(F.array(*[F.lit(c) for c in sorted(CATS)]), F.col("prediction").cast("int") + 1).alias("prediction"))

    return run


def pilot_sample(spark: SparkSession, d: str) -> DataFrame:
    frame = pilot.with_stratum(relations.direct_replies(posts(spark, d))).where("root_tweet_id <> ''")
    return pilot.sample(frame, 300, 5)


def splits(spark: SparkSession, d: str) -> DataFrame:
    return pilot.group_split(posts(spark, d).where("root_tweet_id <> ''"), "root_tweet_id", {"train": 0.70, "validation": 0.15, "test": 0.15})


def model_predictions(spark: SparkSession, d: str) -> DataFrame:
    data = labelled(spark, d).where(F.col("a1").isin(*CATS)).select("tweet_id", "root_tweet_id", T.model_text(F.col("teks_komentar")).alias("text"), F.col("a1").alias("label"))
    data = Scratch(spark).save(data)
    return ml.predictions(ml.build("E3").fit(data), data, sorted(CATS), "1")


def sentiments(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower(T.text_or_blank(F.col("teks_komentar")))
    label = F.when(low.rlike("enak|mantap|salut|segar"), "positif").when(low.rlike("basi|hambar|telat|bau"), "negatif").otherwise("netral")
    return table(spark, d, "threads").select(label.alias("sentiment"), F.col("teks_komentar").startswith("RT @").alias("is_retweet"), F.coalesce("keyword_matched", F.lit("")).alias("keyword"))


def queries() -> dict:
    t = table
    opt = T.Cleansing
    q = {
        # sources and sinks
        "s1_durable_scan": durable_scan,
        "s2_id_scan": id_scan,
        "s10_lexicons": lexicons,
        "s15_lines": lines_round_trip,
        "k4_mapping": mapping_round_trip,
        "s4_import_rows": lambda s, d: relations.import_legacy(t(s, d, "legacy_import"), t(s, d, "threads"), 2).groupBy("status", "reject", "eligible").agg(F.count(F.lit(1)).alias("n")),
        "s5_dataset": lambda s, d: relations.normalized(t(s, d, "threads")).select("tweet_id", "root_tweet_id", "conversation_id", "in_reply_to_tweet_id", "jumlah_likes", "jumlah_view"),
        "s9_dictionary": lambda s, d: lexicon.mapping_rows(t(s, d, "slang_map")),
        "s19_tail": lambda s, d: summary.tail(t(s, d, "threads").select("captured_at", "tweet_id", F.coalesce("root_tweet_id", F.lit("")).alias("root_tweet_id"), F.coalesce("jumlah_likes", F.lit(0)).alias("jumlah_likes")), ["captured_at", "tweet_id", "root_tweet_id", "jumlah_likes"]).drop("captured_at"),
        "k3_csv_round_trip": csv_round_trip,
        "k12_formula_guard": text_query(T.formula_guard),
        # projections
        "proj1_build_rows": lambda s, d: relations.build_rows(t(s, d, "threads")).select("tweet_id", "root_tweet_id", "level", "reject", "url"),
        "proj2_ids": lambda s, d: t(s, d, "threads").select(*[I.normalize_id(F.col(c)).alias(c) for c in relations.CORE[:4]]),
        "proj4_language": lambda s, d: t(s, d, "threads").groupBy(T.language(F.col("bahasa")).alias("language")).agg(F.count(F.lit(1)).alias("n")),
        "proj5_level": lambda s, d: relations.with_level(t(s, d, "threads")).groupBy("level").agg(F.count(F.lit(1)).alias("n")),
        "proj6_legacy_rows": lambda s, d: relations.legacy_rows(t(s, d, "legacy_import")),
        "proj8_direct_replies": lambda s, d: relations.direct_replies(t(s, d, "threads")).select("tweet_id", "root_tweet_id"),
        "proj9_annotation_template": lambda s, d: relations.with_context(relations.direct_replies(posts(s, d)), relations.roots_of(posts(s, d))).select("tweet_id", "root_tweet_id", "teks_root", "teks_komentar", *[F.lit("").alias(c) for c in ("kategori_utama", "subkategori_primer", "kategori_sekunder", "annotation_status")]),
        # filters
        "f1_roots": lambda s, d: relations.normalized(t(s, d, "threads")).where(relations.is_root(F.col("teks_komentar"), F.col("tweet_id"), F.col("conversation_id"), F.col("in_reply_to_tweet_id"))).select("tweet_id").distinct(),
        "f2_language": lambda s, d: t(s, d, "threads").where(T.language_matches(F.col("bahasa"), "id")).select("tweet_id"),
        "f3_relevant": lambda s, d: t(s, d, "threads").where(T.relevant(F.col("teks_komentar"))).select("tweet_id"),
        "f3_topic": lambda s, d: t(s, d, "threads").where(T.relevant(F.col("teks_komentar"), DATA_TOPIC)).select("tweet_id"),
        "f6_topic_quality": lambda s, d: t(s, d, "threads").agg(F.count(F.lit(1)).alias("total"), F.count_if(T.good_quality(F.col("teks_komentar"), DATA_TOPIC)).alias("good")),
        "f4_meaningful": lambda s, d: t(s, d, "threads").where(~T.meaningful(F.col("teks_komentar"))).select("tweet_id"),
        "f5_official_links": lambda s, d: t(s, d, "threads").where(T.only_official_link(F.col("teks_komentar"))).select("tweet_id"),
        "f6_quality": lambda s, d: t(s, d, "threads").agg(F.count(F.lit(1)).alias("total"), F.count_if(T.good_quality(F.col("teks_komentar"))).alias("good"), F.count_if(~T.good_quality(F.col("teks_komentar"))).alias("rejected")),
        "f7_threshold": lambda s, d: relations.roots_of(posts(s, d)).where("jumlah_reply >= 3").select("tweet_id", "jumlah_reply"),
        "f9_ids": lambda s, d: t(s, d, "legacy_import").agg(F.count_if(~I.normalize_id(F.col("tweet_id")).rlike("^[0-9]+$")).alias("not_digits"), F.count_if(I.normalize_id(F.col("tweet_id")).rlike(T.SCIENTIFIC)).alias("scientific")),
        "f10_seed_ids": lambda s, d: relations.seed_ids(t(s, d, "legacy_import").where("url is not null"), "url", "url").select("seed_id", "valid"),
        "f11_pending": lambda s, d: relations.pending_roots(relations.roots_of(posts(s, d)).where("jumlah_reply >= 1").select("tweet_id"), streams.root_states(posts(s, d)).withColumnRenamed("root_tweet_id", "tweet_id"), False),
        "f12_done_queries": lambda s, d: t(s, d, "legacy_import").select(T.query_key(F.lit("Latest"), "keyword_matched").alias("k")).where("k is not null").distinct().join(t(s, d, "threads").where("jumlah_likes > 50").select(T.query_key(F.lit("Latest"), "keyword_matched").alias("k")).distinct(), "k", "left_anti"),
        "f13_ready": lambda s, d: ml.ready(labelled(s, d), "a1", CATS),
        "f14_pairs": lambda s, d: t(s, d, "pilot_raw").agg(F.count_if(clean_label(F.col("annotator_1")).isin(*CATS)).alias("valid"), F.count_if(~clean_label(F.col("annotator_1")).isin(*CATS)).alias("invalid")),
        "f15_search": lambda s, d: lexicon.valid_mapping(t(s, d, "slang_map")).where(F.contains("slang", F.lit("an")) | F.contains("kata_baku", F.lit("an"))),
        "f16_abstention": lambda s, d: scores(s, d).select("tweet_id", metrics.abstention(T.top_two(F.col("p"))[1], T.top_two(F.col("p"))[2]).alias("status")),
        "f18_eligible": lambda s, d: relations.with_context(relations.direct_replies(posts(s, d)), relations.roots_of(posts(s, d))).agg(F.count(F.lit(1)).alias("replies"), F.count_if((F.trim(T.text_or_blank(F.col("teks_root"))) != "") & (F.trim(T.text_or_blank(F.col("teks_komentar"))) != "")).alias("eligible")),
        # joins
        "j1_root_context": lambda s, d: relations.with_context(relations.direct_replies(posts(s, d)), relations.roots_of(posts(s, d))).select("tweet_id", "root_tweet_id", "teks_root"),
        "j2_ambiguous_roots": lambda s, d: relations.ambiguous_roots(relations.roots_of(t(s, d, "threads"))),
        "j3_orphans": lambda s, d: relations.orphan_replies(relations.normalized(t(s, d, "threads"))).groupBy("root_tweet_id").agg(F.count(F.lit(1)).alias("n")),
        "j4_difference": lambda s, d: relations.difference(t(s, d, "pilot_raw"), t(s, d, "coordinator_sampling"), "tweet_id"),
        "j5_dedup": lambda s, d: posts(s, d).select("tweet_id", "jumlah_likes", "captured_at").drop("captured_at"),
        "j8_first_root_text": lambda s, d: relations.roots_of(posts(s, d)).select("tweet_id", "teks_komentar"),
        "j9_side_by_side": lambda s, d: t(s, d, "annotation_marks").groupBy("tweet_id").agg(F.max(F.when(F.col("slot") == 1, F.struct("marked_at", "mark"))).getField("mark").alias("one"), F.max(F.when(F.col("slot") == 2, F.struct("marked_at", "mark"))).getField("mark").alias("two")),
        "j13_leakage": lambda s, d: pilot.leakage(t(s, d, "threads").where("root_tweet_id is not null and tweet_id is not null").select("root_tweet_id", (F.col("sumber_akuisisi")).alias("part")).where("part is not null"), "root_tweet_id"),
        # aggregations
        "a1_audit": lambda s, d: audit.audit(relations.normalized(t(s, d, "threads")), t(s, d, "coordinator_sampling")),
        "a2_duplicates": lambda s, d: audit.duplicate_ids(t(s, d, "threads")),
        "a2_dataset": lambda s, d: audit.dataset_audit(relations.normalized(t(s, d, "threads"))),
        "a3_reply_statistics": lambda s, d: audit.reply_statistics(relations.normalized(t(s, d, "threads"))),
        "a4_heavy_roots": lambda s, d: audit.heavy_roots(relations.normalized(t(s, d, "threads")), 50),
        "a5_distribution": lambda s, d: audit.distribution(t(s, d, "threads"), "sumber_akuisisi"),
        "a7_contract": lambda s, d: audit.contract(relations.normalized(t(s, d, "threads"))),
        "a9_frame": lambda s, d: audit.frame_check(t(s, d, "pilot_raw").withColumn("label", clean_label(F.col("annotator_1"))), "teks_komentar", "label", CATS, "root_tweet_id"),
        "a10_repeated_texts": lambda s, d: audit.repeated_texts(t(s, d, "threads")),
        "a11_vocabulary": lambda s, d: lexicon.vocabulary(t(s, d, "threads"), "teks_komentar"),
        "a12_candidates": lambda s, d: lexicon.candidates(t(s, d, "slang_map"), lexicon.vocabulary(t(s, d, "threads"), "teks_komentar")),
        "a13_coverage": lambda s, d: lexicon.coverage(t(s, d, "threads"), "teks_komentar", t(s, d, "slang_map")),
        "a14_summary": lambda s, d: summary.label_summary(sentiments(s, d)),
        "a15_grouped_summary": lambda s, d: summary.label_summary(sentiments(s, d), "keyword"),
        "a16_reconcile": lambda s, d: relations.reconcile(t(s, d, "threads"), t(s, d, "coordinator_sampling").select("tweet_id").distinct(), t(s, d, "pilot_raw").select("tweet_id").distinct(), 3),
        "a17_import_counts": lambda s, d: relations.import_counts(relations.import_legacy(t(s, d, "legacy_import"), t(s, d, "threads"), 2)),
        "a18_root_coverage": lambda s, d: pilot.root_coverage(t(s, d, "pilot_raw")),
        "a19_digests": lambda s, d: audit.file_digest(s, f"{d}/slang_map.parquet").select("length", "sha256", "newlines", "bom"),
        "a20_progress": lambda s, d: metrics.annotation_progress(t(s, d, "pilot_raw").distinct()),
        # order, windows, sets, splits
        "o1_top_users": lambda s, d: summary.top(t(s, d, "threads"), "username"),
        "o2_rank": lambda s, d: lexicon.rank(lexicon.valid_mapping(t(s, d, "slang_map")).withColumn("source", F.when(F.length("slang") > 4, "elongation").otherwise("review")), 30),
        "o6_shuffle": lambda s, d: t(s, d, "pilot_raw").select("tweet_id").distinct().orderBy(F.md5(F.concat_ws("|", F.lit("20260907"), "tweet_id"))).limit(100),
        "o6_shuffle_all": lambda s, d: t(s, d, "pilot_raw").select("tweet_id").distinct().orderBy(F.md5(F.concat_ws("|", F.lit("20260907"), "tweet_id"))),
        "w1_position": lambda s, d: pilot.hash_positions(posts(s, d).select("tweet_id", "root_tweet_id"), ["root_tweet_id"], F.md5(F.concat_ws("|", F.lit("7"), "tweet_id")), "tweet_id"),
        "w2_pilot_sample": pilot_sample,
        "w4_strata": lambda s, d: pilot.with_stratum(t(s, d, "threads")).groupBy("stratum", "reason").agg(F.count(F.lit(1)).alias("n")),
        "x1_sets": lambda s, d: t(s, d, "coordinator_sampling").select("tweet_id").intersect(t(s, d, "pilot_raw").select("tweet_id")),
        "x2_union": lambda s, d: t(s, d, "pilot_raw").select("tweet_id").unionByName(t(s, d, "removal_log").select("tweet_id")).groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n")),
        "x3_ordered_distinct": lambda s, d: summary.ordered_distinct(t(s, d, "threads").where("keyword_matched is not null").select("keyword_matched", "captured_at", "tweet_id"), "keyword_matched", ["captured_at", "tweet_id"]),
        "g1_split": splits,
        "g3_folds": lambda s, d: pilot.folds(posts(s, d), "root_tweet_id", 5),
        "g4_no_leakage": lambda s, d: pilot.leakage(posts(s, d).join(splits(s, d), "root_tweet_id"), "root_tweet_id"),
        # text
        "t1_cleanse": text_query(T.cleanse),
        "t1_cleanse_remove": text_query(lambda c: T.cleanse(c, opt(url_mode="remove", mention_mode="remove"))),
        "t1_cleanse_keep": text_query(lambda c: T.cleanse(c, opt(lowercase=False, url_mode="keep", mention_mode="keep"))),
        "t4_no_emoji": text_query(lambda c: T.cleanse(c, opt(keep_emoji=False))),
        "t5_no_punctuation": text_query(lambda c: T.cleanse(c, opt(keep_emoji=False, keep_punctuation=False))),
        "t6_normalize": lambda s, d: text_query(lambda c: T.replace_tokens(T.text_or_blank(c), slang(s, d)))(s, d),
        "t7_model_text": lambda s, d: text_query(lambda c: T.model_text(c, slang(s, d), remove_stopwords=True))(s, d),
        "t8_slang_words": lambda s, d: text_query(lambda c: T.replace_words(T.text_or_blank(c), slang(s, d)))(s, d),
        "t10_stopwords": text_query(lambda c: T.drop_stopwords(T.text_or_blank(c))),
        "t11_nfc": lambda s, d: t(s, d, "documents").select("doc_id", T.nfc(F.col("text")).alias("out")),
        "t12_nfkc": text_query(T.nfkc),
        "t16_pair_text": lambda s, d: t(s, d, "pilot_raw").select("tweet_id", T.pair_text(F.col("teks_root"), F.col("teks_komentar")).alias("out")),
        "t17_search_query": lambda s, d: t(s, d, "threads").select("keyword_matched").distinct().where("keyword_matched is not null").select(T.search_query(F.col("keyword_matched")).alias("out")),
        "t19_canonical": lambda s, d: t(s, d, "slang_map").select(lexicon.canonical(T.text_or_blank(F.col("kata_baku")), {"nggak": "tidak", "gak": "nggak", "udah": "sudah"}).alias("out")).distinct(),
        "t20_elongations": lambda s, d: lexicon.elongations(lexicon.vocabulary(t(s, d, "threads"), "teks_komentar"), lexicon.vocabulary(t(s, d, "threads"), "teks_komentar").where("n > 200").select(F.col("token").alias("word"), F.col("token").alias("target"))),
        "t22_retry": text_query(lambda c: T.retry_wait(T.text_or_blank(c), 120, 15)),
        "t23_stamps": lambda s, d: t(s, d, "events").select("event_id", T.stamp(F.col("ts")).alias("at")),
        "proj3_ids": lambda s, d: t(s, d, "orders").select("o_orderkey", T.id_of(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))), F.col("o_custkey")).alias("id")),
        "t23_months": lambda s, d: t(s, d, "threads").groupBy(F.date_format(F.expr("try_to_timestamp(waktu_posting)"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")),
        "t25_progress": text_query(lambda c: T.progress(T.text_or_blank(c), 1000)),
        "t26_json": lambda s, d: t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")),
        "t27_arrays": lambda s, d: t(s, d, "pilot_raw").groupBy("root_tweet_id").agg(F.array_join(F.array_sort(F.collect_set("tweet_id")), ",").alias("members")),
        "t28_margin": lambda s, d: scores(s, d).select("tweet_id", T.top_two(F.col("p"))[0].alias("best"), T.top_two(F.col("p"))[1].alias("confidence"), T.top_two(F.col("p"))[2].alias("margin")),
        "t29_percent": lambda s, d: t(s, d, "threads").groupBy("bahasa").agg(summary.percent(F.count_if(F.col("jumlah_likes") > 10), F.count(F.lit(1))).alias("pct")),
        # metrics
        "m1_class_metrics": lambda s, d: metrics.class_metrics(metrics.confusion(predicted(s, d), "true", "pred")),
        "m1_overall": lambda s, d: metrics.overall(metrics.confusion(predicted(s, d), "true", "pred")),
        "m2_bootstrap": lambda s, d: metrics.bootstrap(predicted(s, d), "true", "pred", "root_tweet_id", 200),
        "m2_bootstrap_1000": lambda s, d: metrics.bootstrap(predicted(s, d), "true", "pred", "root_tweet_id"),
        "m3_kappa": lambda s, d: metrics.kappa(labelled(s, d), "a1", "a2"),
        "m3_matrix": lambda s, d: metrics.agreement_matrix(labelled(s, d), "a1", "a2"),
        "m5_per_root": lambda s, d: metrics.per_group_f1(predicted(s, d), "true", "pred", "root_tweet_id"),
        "m6_gates": lambda s, d: metrics.gates(relations.one_row(metrics.overall(metrics.confusion(predicted(s, d), "true", "pred")).select("macro_f1", "balanced_accuracy"), metrics.class_metrics(metrics.confusion(predicted(s, d), "true", "pred")).agg(F.min("recall").alias("least_recall"))).withColumns({"val_macro_f1": F.lit(None).cast("double"), "test_macro_f1": F.lit(None).cast("double"), "n_leaks": F.lit(0)})),
        "m7_calibration": lambda s, d: metrics.calibration_grid(predicted(s, d), "true", "pred", "confidence", "margin"),
        "m20_row_check": lambda s, d: t(s, d, "pilot_raw").groupBy(metrics.row_check(t(s, d, "pilot_raw")).alias("state")).agg(F.count(F.lit(1)).alias("n")),
        "m21_adjudication": lambda s, d: metrics.adjudicated(t(s, d, "pilot_raw").distinct()),
        # models (no SQL)
        "m11_most_frequent": lambda s, d: ml.most_frequent(labelled(s, d).where(F.col("a1").isin(*CATS)), "a1"),
        "m22_keyword_labels": lambda s, d: ml.keyword_label(labelled(s, d).select("tweet_id", F.col("teks_komentar").alias("text"))).select("tweet_id", "prediction"),
        "m4_category_kappa": lambda s, d: metrics.category_kappa(labelled(s, d), "a1", "a2"),
        "m8_predictions": model_predictions,
        "w3_escalating_sample": lambda s, d: pilot.escalating_sample(pilot.with_stratum(relations.direct_replies(posts(s, d)), rules=pilot.WIDE_RULES).where("root_tweet_id <> ''"), 60, (3, 4, 5, 300), strata=pilot.WIDE_STRATA, partial=True),
        "w5_prepare_pilot": lambda s, d: pilot.prepare(posts(s, d), 300, 5, "1.0", partial=True),
        "proj10_blind": lambda s, d: pilot.blind(t(s, d, "pilot_raw"), "2.0"),
        "proj13_label_map": lambda s, d: pilot.label_map(labelled(s, d), "a1"),
        "x4_presets": lambda s, d: pilot.presets({k: [*w, k.lower()] for k, w in pilot.RULES.items()}, s),
        "f8_required": lambda s, d: t(s, d, "threads").agg(*[F.count_if(audit.blank(F.col(c))).alias(c) for c in files.REQUIRED]),
        "a6_sorted_counter": lambda s, d: audit.distribution(t(s, d, "threads"), "bahasa").orderBy(F.desc("n"), "value"),
        "a8_source_audit": lambda s, d: relations.one_row(audit.audit(relations.normalized(t(s, d, "threads"))).select("total_rows", "distinct_ids", "invalid_ids", "orphans"), t(s, d, "threads").agg(F.count_if(~F.coalesce("hierarki_komentar", F.lit("")).isin("Root_Tweet", "Direct_Reply", "Nested_Reply")).alias("open_levels"))),
        "f10_queue_seeds": lambda s, d: relations.queue_seeds(relations.seed_ids(t(s, d, "legacy_import").where("url is not null"), "url", "url"), relations.roots_of(posts(s, d)).select("tweet_id", F.coalesce("keyword_matched", F.lit("")).alias("keyword_matched"))),
        # streams
        "r1_discover": lambda s, d: streams.discover(t(s, d, "threads")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
        "r3_deferred": lambda s, d: streams.deferred(t(s, d, "threads")).select("tweet_id").distinct(),
        "r3_stream_deferred": lambda s, d: streams.stream_deferred(s, f"{d}/threads.parquet*", t(s, d, "threads").schema).select("tweet_id").distinct(),
        "r4_root_states": lambda s, d: streams.root_states(t(s, d, "threads")),
        "r9_stream_distinct": lambda s, d: streams.stream_distinct(s, f"{d}/threads.parquet*", t(s, d, "threads").schema, "tweet_id").select("tweet_id"),
        "r_windows": lambda s, d: streams.windowed_counts(s, f"{d}/events.parquet*", t(s, d, "events").schema, "ts", "1 day", "2 hours", "event_type"),
        "o3_quota": lambda s, d: streams.quota(t(s, d, "threads"), 500, ["captured_at", "tweet_id", "root_tweet_id"]).select("tweet_id"),
    }
    for name, key in (("m12_bernoulli", "E2"), ("m13_multinomial", "E3"), ("m14_complement", "E4"), ("m15_words_and_characters", "E5"), ("m16_root_context", "E6"), ("m17_linear", "Audit")):
        q[name] = fit_predict(key)
    return q


# SQL ---------------------------------------------------------------------------------------------------------------


# The constants below are written out for the SQL by hand; nothing of the library's own patterns enters it.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLACK = r"[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_URL = f"(?i)(https?://{BLACK}+|www\\.{BLACK}+)"
SQL_HTTP = f"https?://{BLACK}+"
SQL_HANDLE = r"@[\p{L}\p{N}_]+"
SQL_MENTION = r"(^|[^\p{L}\p{N}_])@[A-Za-z0-9_]+"
SQL_EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]+"
SQL_PUNCTUATION = r"[^\p{L}\p{N}_\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}'-]"
SQL_TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"
SQL_SCIENTIFIC = r"^[+-]?[0-9]+(\.[0-9]+)?[Ee][+-]?[0-9]+$"
SQL_BOOLEAN = r"(?i)(\b(OR|AND|NOT)\b|[()]|(^|\s)-?filter:)"
SQL_SEED = r"(?i)(?:status/)?([0-9]{6,})/?(\?.*)?$"
SQL_TOPIC = f"(?i)((^|[^\\p{{L}}\\p{{N}}_])mbg($|[^\\p{{L}}\\p{{N}}_])|makan{WS}+bergizi|makan{WS}+siang{WS}+gratis|makan{WS}+gratis{WS}+(anak{WS}+)?sekolah|embege|makanbergizigratis)"
SQL_STOPWORDS = "yang dan di ke dari ini itu untuk dengan pada adalah akan juga sudah saya kami mereka kita ada bisa atau oleh jika saat agar hanya lebih serta antara karena tetapi namun maka lalu pun kalau supaya demi selain sebagai yakni bahwa".split()
SQL_KEPT = "tidak bukan belum jangan kurang tanpa mbg sppg bgn 3t slhs haccp".split()
SQL_RULES = {
    "Mutu_Gizi": "porsi gizi nutrisi protein kalori karbohidrat sayur buah lauk menu rasa hambar asin manis enak kenyang basi busuk berjamur keracunan mual diare higienis higiene sanitasi kontaminasi kedaluwarsa".split(),
    "Tata_Kelola": ["tindak lanjut", *"vendor dapur mitra sppg sertifikasi anggaran dana biaya korupsi audit transparan akuntabel pengaduan aduan bgn sop inspeksi verifikasi".split()],
    "Distribusi": "terlambat kirim logistik distribusi jangkauan 3t pelosok perbatasan kemasan bocor tumpah pembagian paket wadah".split(),
}
SQL_TAXONOMY = {
    "Mutu_Gizi": "Kecukupan_Porsi_dan_Nutrisi Variasi_dan_Rasa_Menu Keamanan_Konsumsi".split(),
    "Tata_Kelola": "Standardisasi_Vendor_dan_Dapur Transparansi_dan_Efisiensi_Anggaran Responsivitas_Aduan".split(),
    "Distribusi": "Ketepatan_Waktu_Logistik Pemerataan_Jangkauan_3T Kondisi_Fisik_dan_Pembagian".split(),
}
SQL_IDS = "tweet_id root_tweet_id conversation_id in_reply_to_tweet_id".split()
SQL_COUNTERS = "jumlah_likes jumlah_retweet followers_count jumlah_reply jumlah_quote jumlah_view".split()
SQL_FIELDS = SQL_IDS + "waktu_posting username teks_komentar jumlah_likes jumlah_retweet sumber_akuisisi hierarki_komentar display_name followers_count bahasa jumlah_reply jumlah_quote jumlah_view keyword_matched url".split()
SQL_STRATA = "Distribusi_Signal Tata_Kelola_Signal Mutu_Gizi_Signal Overlap No_Signal".split()


def nid(c: str) -> str:
    return f"CASE WHEN lower(trim(coalesce({c}, ''))) = 'none' THEN '' ELSE trim(coalesce({c}, '')) END"


def sq(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def txt(c: str = "teks_komentar") -> str:
    return f"coalesce({c}, '')"


def collapsed(e: str) -> str:
    return f"trim(regexp_replace({e}, {sq(WS + '+')}, ' ', 'g'))"


def cleaned(lower=True, url=" url ", mention=r"\1 user ", emoji=True, punctuation=True) -> str:
    e = f"nfc_normalize({txt()})"
    if lower:
        e = f"lower({e})"
    if url is not None:
        e = f"regexp_replace({e}, {sq(SQL_URL)}, '{url}', 'g')"
    if mention is not None:
        for _ in range(2):
            e = f"regexp_replace({e}, {sq(SQL_MENTION)}, '{mention}', 'g')"
    if not emoji:
        e = f"regexp_replace({e}, {sq(SQL_EMOJI)}, ' ', 'g')"
    if not punctuation:
        e = f"regexp_replace({e}, {sq(SQL_PUNCTUATION)}, ' ', 'g')"
    return collapsed(e)


N_SQL = "n AS (SELECT * REPLACE (" + ", ".join(f"{nid(c)} AS {c}" for c in SQL_IDS) + ", " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in SQL_COUNTERS) + ") FROM threads)"
LEVEL_SQL = "CASE WHEN root_tweet_id = '' OR conversation_id <> root_tweet_id THEN 'Outside_Conversation' WHEN tweet_id = root_tweet_id THEN 'Root_Tweet' WHEN in_reply_to_tweet_id = '' THEN 'Invalid_Reply' WHEN in_reply_to_tweet_id = root_tweet_id THEN 'Direct_Reply' ELSE 'Nested_Reply' END"
ROOT_SQL = f"tweet_id <> '' AND conversation_id = tweet_id AND in_reply_to_tweet_id = '' AND NOT starts_with(ltrim({txt()}), 'RT @')"
POSTS_SQL = N_SQL + """, posts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY captured_at, root_tweet_id, jumlah_likes, conversation_id NULLS FIRST, in_reply_to_tweet_id, waktu_posting NULLS FIRST, username NULLS FIRST, teks_komentar NULLS FIRST, jumlah_retweet) AS rn FROM n) WHERE rn = 1)"""
LETTERS_SQL = "lower(regexp_replace(coalesce({0}, ''), '[^\\p{{L}}]', '', 'g'))"


def label_sql(c: str) -> str:
    low = LETTERS_SQL.format(c)
    return f"CASE {low} WHEN 'mutugizi' THEN 'Mutu_Gizi' WHEN 'tatakelola' THEN 'Tata_Kelola' WHEN 'distribusi' THEN 'Distribusi' ELSE {low} END"


LABELLED_SQL = f"lab AS (SELECT DISTINCT tweet_id, root_tweet_id, teks_root, teks_komentar, {label_sql('annotator_1')} AS a1, {label_sql('annotator_2')} AS a2, annotator_1, annotator_2, adjudicated_label, kategori_utama, subkategori_primer, kategori_sekunder, annotation_status FROM pilot_raw)"
CATS_SQL = "('Mutu_Gizi', 'Tata_Kelola', 'Distribusi')"
PRED_SQL = LABELLED_SQL + f", pred AS (SELECT tweet_id, root_tweet_id, a2 AS t, a1 AS p, (length({txt()}) % 61) / 100.0::DOUBLE + 0.39 AS confidence, (length({txt()}) % 31) / 100.0::DOUBLE AS margin FROM lab WHERE a1 IN {CATS_SQL} AND a2 IN {CATS_SQL}), labels AS (SELECT unnest(['Mutu_Gizi', 'Tata_Kelola', 'Distribusi']) AS label)"
CLASS_SQL = PRED_SQL + """, cm AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (p = label) AS told, count(*) FILTER (t = label) AS support FROM pred, labels GROUP BY label),
cls AS (SELECT label, CASE WHEN told > 0 THEN tp / told ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CASE WHEN told + support > 0 AND tp > 0 THEN 2.0 * tp / (told + support) ELSE 0.0 END AS f1, support FROM cm)"""
SCORES_SQL = POSTS_SQL + ", sc AS (SELECT tweet_id, jumlah_likes + 1.0::DOUBLE AS a, jumlah_retweet + 1.0::DOUBLE AS b, jumlah_reply + 1.0::DOUBLE AS c FROM posts), pr AS (SELECT tweet_id, a / (a + b + c) AS x, b / (a + b + c) AS y, c / (a + b + c) AS z FROM sc), tt AS (SELECT tweet_id, CASE WHEN z >= x AND z >= y THEN 2 WHEN y >= x THEN 1 ELSE 0 END AS best, greatest(x, y, z) AS confidence, greatest(x, y, z) - CASE WHEN z >= x AND z >= y THEN greatest(x, y) WHEN y >= x THEN greatest(x, z) ELSE greatest(y, z) END AS margin FROM pr)"
MAP_SQL = f"m0 AS (SELECT lower({collapsed(txt('slang'))}) AS slang, lower({collapsed(txt('kata_baku'))}) AS kata_baku, coalesce(frekuensi, 0) AS frekuensi FROM slang_map), m1 AS (SELECT *, CASE WHEN slang = '' OR kata_baku = '' THEN 'empty' WHEN slang = kata_baku THEN 'identity' END AS p0 FROM m0), m2 AS (SELECT slang, kata_baku, frekuensi, coalesce(p0, CASE WHEN row_number() OVER (PARTITION BY slang, p0 IS NULL ORDER BY frekuensi DESC, kata_baku) > 1 THEN 'duplicate' END) AS problem FROM m1), vm AS (SELECT slang, kata_baku, frekuensi FROM m2 WHERE problem IS NULL), mp AS (SELECT map_from_entries(list({{'k': slang, 'v': kata_baku}})) AS m FROM vm)".replace("{{", "{").replace("}}", "}")
TOKENS_SQL = f"tk AS (SELECT unnest(regexp_extract_all(lower({txt()}), {sq(SQL_TOKEN)})) AS token FROM threads), vocab AS (SELECT token, count(*) AS n FROM tk GROUP BY token)"
LEGACY_SQL = (
    f"leg AS (SELECT {nid('tweet_id')} AS tweet_id, *  EXCLUDE (tweet_id), CASE WHEN NOT regexp_full_match({nid('tweet_id')}, '[0-9]+') THEN 'bad_id' WHEN trim(coalesce(step, '')) <> '1_root' OR {nid('root_tweet_id')} <> '' THEN 'not_a_root' WHEN lower(trim(coalesce(is_retweet, '0'))) IN ('1', 'true', 'yes', 'y') THEN 'retweet'"
    f" WHEN length({collapsed('regexp_replace(regexp_replace(' + txt('content') + ', ' + sq(SQL_URL) + ', chr(32), chr(103)), ' + sq(SQL_HANDLE) + ', chr(32), chr(103))')}) < 3 THEN 'no_text' END AS reject FROM legacy_import)"
)
LEGINT = "coalesce(CASE WHEN regexp_full_match(trim({0}), '[+-]?[0-9]+') THEN try_cast(trim({0}) AS BIGINT) END, 0)"
IMPORT_SQL = LEGACY_SQL + f", tag AS (SELECT *, row_number() OVER (PARTITION BY tweet_id, reject IS NULL ORDER BY coalesce(created_at, ''), {txt('content')}, {LEGINT.format('like_count')}) AS rn FROM leg), st AS (SELECT *, CASE WHEN reject IS NOT NULL THEN 'rejected' WHEN rn > 1 OR tweet_id IN (SELECT {nid('tweet_id')} FROM threads) THEN 'duplicate' ELSE 'imported' END AS status FROM tag), st2 AS (SELECT *, status = 'imported' AND {LEGINT.format('reply_count')} >= 2 AS eligible FROM st)"
MEANING = lambda c: f"length({collapsed('regexp_replace(regexp_replace(' + txt(c) + ', ' + sq(SQL_URL) + ', chr(32), chr(103)), ' + sq(SQL_HANDLE) + ', chr(32), chr(103))')}) >= 3"
OFFICIAL = "(" + " OR ".join(f"contains(lower({txt()}), '{h}')" for h in ("linimasa.example", "tautan.example")) + f") AND length(trim(regexp_replace({txt()}, {sq(SQL_URL)}, '', 'g'))) < 30"
GOOD = f"({MEANING('teks_komentar')}) AND regexp_matches({txt()}, {sq(SQL_TOPIC)}) AND NOT regexp_matches({txt()}, {sq(SQL_URL)}) AND NOT ({OFFICIAL})"
LANG = "CASE WHEN lower(trim(coalesce({0}, ''))) IN ('', '*', 'all', 'semua') THEN '' WHEN lower(trim(coalesce({0}, ''))) IN ('id', 'ind', 'indonesia', 'bahasa indonesia', 'in') THEN 'in' ELSE lower(trim(coalesce({0}, ''))) END"
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in SQL_STOPWORDS) + "]"
KEEP_LIST = "[" + ", ".join(f"'{w}'" for w in SQL_KEPT) + "]"
WORDS = lambda e: f"list_filter(string_split_regex({e}, {sq(WS + '+')}), lambda x: x <> '')"
NOSTOP = lambda e: f"coalesce(array_to_string(list_filter({WORDS(e)}, lambda x: list_contains({KEEP_LIST}, lower(x)) OR NOT list_contains({STOP_LIST}, lower(x))), ' '), '')"
MAPPED = lambda e: f"coalesce(array_to_string(list_transform({WORDS(e)}, lambda x: coalesce(m[lower(x)], x)), ' '), '')"
SENT_SQL = f"sent AS (SELECT CASE WHEN regexp_matches(lower({txt()}), 'enak|mantap|salut|segar') THEN 'positif' WHEN regexp_matches(lower({txt()}), 'basi|hambar|telat|bau') THEN 'negatif' ELSE 'netral' END AS s, coalesce(starts_with(teks_komentar, 'RT @'), false) AS rt, coalesce(keyword_matched, '') AS keyword FROM threads)"
SUM_COLS = "count(*) AS total, count(*) FILTER (rt) AS retweets, " + ", ".join(f"count(*) FILTER (s = '{x}') AS n_{x}" for x in ("positif", "negatif", "netral")) + ", count(*) FILTER (NOT rt) AS originals, " + ", ".join(f"count(*) FILTER (s = '{x}') * 100.0 / count(*) AS pct_{x}" for x in ("positif", "negatif", "netral"))
REPLIES_SQL = N_SQL + ", rep AS (SELECT root_tweet_id, count(*) AS n_replies FROM n WHERE hierarki_komentar = 'Direct_Reply' AND root_tweet_id <> '' GROUP BY 1)"
CONTEXT_SQL = POSTS_SQL + ", ctx AS (SELECT p.*, r.teks_komentar AS teks_root, r.tweet_id IS NOT NULL AS has FROM (SELECT * FROM posts WHERE hierarki_komentar = 'Direct_Reply') p LEFT JOIN (SELECT * FROM posts WHERE hierarki_komentar = 'Root_Tweet') r ON r.tweet_id = p.root_tweet_id)"
STRATUM = {k: f"regexp_matches({txt()}, {sq('(?i)(^|[^\\p{L}\\p{N}_])(' + '|'.join(w) + ')($|[^\\p{L}\\p{N}_])')})" for k, w in SQL_RULES.items()}
STATES_SQL = f"lv AS (SELECT *, {LEVEL_SQL} AS level FROM {{src}}), states AS (SELECT root_tweet_id, CASE WHEN count(*) FILTER (level = 'Root_Tweet') = 0 THEN 'invalid_root' WHEN count(*) FILTER (level = 'Nested_Reply') > 0 THEN 'all_exhausted' WHEN count(*) FILTER (level = 'Direct_Reply') > 0 THEN 'direct_exhausted' ELSE 'pending' END AS status FROM lv WHERE root_tweet_id <> '' GROUP BY 1)"
ADJ = "CASE WHEN trim(coalesce(annotator_1, '')) = '' OR trim(coalesce(annotator_2, '')) = '' THEN 'BELUM_LENGKAP' WHEN trim(coalesce(annotator_1, '')) = trim(coalesce(annotator_2, '')) THEN 'SETUJU' ELSE 'BEDA' END"
ADJ_SQL = f"d AS (SELECT DISTINCT * FROM pilot_raw), s1 AS (SELECT *, {ADJ} AS state, upper(trim(coalesce(annotator_1, ''))) = 'UNCLEAR' AS unclear FROM d), s2 AS (SELECT tweet_id, state, CASE WHEN state = 'SETUJU' AND NOT unclear THEN trim(coalesce(annotator_1, '')) ELSE trim(coalesce(adjudicated_label, '')) END AS final_label, unclear FROM s1), s3 AS (SELECT tweet_id, state, final_label, CASE WHEN state = 'BELUM_LENGKAP' THEN 'BELUM_LENGKAP' WHEN state = 'SETUJU' AND NOT unclear THEN 'SIAP' WHEN state = 'SETUJU' THEN 'UNCLEAR' WHEN final_label <> '' THEN 'ADJUDICATED' ELSE 'REVIEW' END AS final_status FROM s2)"


def outs(e: str) -> str:
    return f"SELECT tweet_id, {e} AS out FROM threads"


def oracle_sql() -> dict[str, str]:
    bad = " OR ".join(f"({c} <> '' AND NOT regexp_full_match({c}, '[0-9]+'))" for c in SQL_IDS)
    sci = " OR ".join(f"regexp_matches({c}, {sq(SQL_SCIENTIFIC)})" for c in SQL_IDS)
    pairs = " OR ".join(f"(trim(coalesce(kategori_utama, '')) = '{c}' AND trim(coalesce(subkategori_primer, '')) IN ({', '.join(repr(x) for x in subs)}))" for c, subs in SQL_TAXONOMY.items())
    empty = "trim(coalesce(kategori_utama, '')) = '' AND trim(coalesce(subkategori_primer, '')) = '' AND trim(coalesce(kategori_sekunder, '')) = ''"
    hashed = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
    split_cte = POSTS_SQL + ", g AS (SELECT DISTINCT root_tweet_id AS g FROM posts WHERE root_tweet_id <> ''), r AS (SELECT g, (row_number() OVER (ORDER BY md5('42|' || g), g) - 1) / (count(*) OVER ())::DOUBLE AS at_ FROM g), parts AS (SELECT g AS root_tweet_id, CASE WHEN at_ < 0.7 THEN 'train' WHEN at_ < 0.85 THEN 'validation' ELSE 'test' END AS part FROM r)"
    sql = {
        "s1_durable_scan": f"WITH t AS (SELECT *, trim({txt('tweet_id')}) <> '' AND trim({txt()}) <> '' AND trim({txt('sumber_akuisisi')}) <> '' AND trim({txt('hierarki_komentar')}) <> '' AS ok FROM threads) SELECT count(DISTINCT tweet_id) FILTER (ok) AS n_ids, count(*) FILTER (NOT ok) AS invalid, count(*) FILTER (ok AND hierarki_komentar = 'Root_Tweet' AND coalesce(jumlah_reply, 0) >= 3) AS n_queue FROM t",
        "s2_id_scan": f"SELECT DISTINCT {nid('tweet_id')} AS tweet_id FROM threads WHERE {nid('tweet_id')} <> ''",
        "s10_lexicons": f"WITH {MAP_SQL} SELECT slang, kata_baku, 'tsv' AS source FROM vm UNION ALL SELECT slang, kata_baku, 'csv' FROM vm",
        "s15_lines": "SELECT DISTINCT trim(keyword_matched) AS value FROM threads WHERE trim(keyword_matched) <> ''",
        "k4_mapping": f"WITH {MAP_SQL} SELECT slang, kata_baku, frekuensi FROM vm",
        "s4_import_rows": f"WITH {IMPORT_SQL} SELECT status, reject, eligible, count(*) AS n FROM st2 GROUP BY ALL",
        "s5_dataset": f"WITH {N_SQL} SELECT tweet_id, root_tweet_id, conversation_id, in_reply_to_tweet_id, jumlah_likes, jumlah_view FROM n",
        "s9_dictionary": f"WITH {MAP_SQL} SELECT slang, kata_baku, frekuensi, problem FROM m2",
        "s19_tail": "SELECT tweet_id, coalesce(root_tweet_id, '') AS root_tweet_id, coalesce(jumlah_likes, 0) AS jumlah_likes FROM threads ORDER BY captured_at DESC, tweet_id DESC, coalesce(root_tweet_id, '') DESC, coalesce(jumlah_likes, 0) DESC LIMIT 200",
        "k3_csv_round_trip": "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in SQL_FIELDS) + " FROM threads",
        "k12_formula_guard": outs("CASE WHEN regexp_matches(teks_komentar, '^\\s*[=+\\-@]') THEN '''' || teks_komentar ELSE teks_komentar END"),
        "proj1_build_rows": f"WITH {N_SQL}, l AS (SELECT *, {LEVEL_SQL} AS level, trim(coalesce(sumber_akuisisi, '')) AS src FROM n) SELECT tweet_id, root_tweet_id, level, CASE WHEN tweet_id = '' THEN 'no_id' WHEN src = 'KEYWORD_SEARCH' THEN CASE WHEN conversation_id <> tweet_id OR in_reply_to_tweet_id <> '' THEN 'not_a_root' END WHEN src = 'REPLY_TWEET_ID' THEN CASE WHEN root_tweet_id = '' OR conversation_id = '' OR in_reply_to_tweet_id = '' THEN 'missing_relation' WHEN level NOT IN ('Direct_Reply', 'Nested_Reply') THEN 'outside' END ELSE 'unknown_source' END AS reject, CASE WHEN coalesce(url, '') <> '' THEN url WHEN coalesce(username, '') <> '' THEN 'https://linimasa.example/' || username || '/status/' || tweet_id ELSE '' END AS url FROM l",
        "proj2_ids": "SELECT " + ", ".join(f"{nid(c)} AS {c}" for c in SQL_IDS) + " FROM threads",
        "proj4_language": f"SELECT {LANG.format('bahasa')} AS language, count(*) AS n FROM threads GROUP BY 1",
        "proj5_level": f"WITH {N_SQL} SELECT {LEVEL_SQL} AS level, count(*) AS n FROM n GROUP BY 1",
        "proj6_legacy_rows": f"WITH {LEGACY_SQL} SELECT tweet_id, tweet_id AS root_tweet_id, tweet_id AS conversation_id, '' AS in_reply_to_tweet_id, coalesce(created_at, '') AS waktu_posting, coalesce(username, '') AS username, {txt('content')} AS teks_komentar, {LEGINT.format('like_count')} AS jumlah_likes, {LEGINT.format('retweet_count')} AS jumlah_retweet, 'KEYWORD_SEARCH' AS sumber_akuisisi, 'Root_Tweet' AS hierarki_komentar, coalesce(display_name, '') AS display_name, {LEGINT.format('followers_count')} AS followers_count, coalesce(lang, '') AS bahasa, {LEGINT.format('reply_count')} AS jumlah_reply, {LEGINT.format('quote_count')} AS jumlah_quote, {LEGINT.format('view_count')} AS jumlah_view, coalesce(keyword_matched, '') AS keyword_matched, coalesce(url, '') AS url, reject FROM leg",
        "proj8_direct_replies": "SELECT tweet_id, root_tweet_id FROM threads WHERE hierarki_komentar = 'Direct_Reply'",
        "proj9_annotation_template": f"WITH {CONTEXT_SQL} SELECT tweet_id, root_tweet_id, teks_root, teks_komentar, '' AS kategori_utama, '' AS subkategori_primer, '' AS kategori_sekunder, '' AS annotation_status FROM ctx",
        "f1_roots": f"WITH {N_SQL} SELECT DISTINCT tweet_id FROM n WHERE {ROOT_SQL}",
        "f2_language": f"SELECT tweet_id FROM threads WHERE {LANG.format('bahasa')} = 'in'",
        "f3_relevant": f"SELECT tweet_id FROM threads WHERE regexp_matches({txt()}, {sq(SQL_TOPIC)})",
        "f3_topic": "SELECT tweet_id FROM threads WHERE regexp_matches(coalesce(teks_komentar, ''), '(?i)(makan siang|makan gratis|gizi|dapur|menu|porsi|sekolah)')",
        "f6_topic_quality": f"SELECT count(*) AS total, count(*) FILTER ({GOOD.replace(sq(SQL_TOPIC), sq('(?i)(makan siang|makan gratis|gizi|dapur|menu|porsi|sekolah)'))}) AS good FROM threads",
        "f4_meaningful": f"SELECT tweet_id FROM threads WHERE NOT ({MEANING('teks_komentar')})",
        "f5_official_links": f"SELECT tweet_id FROM threads WHERE {OFFICIAL}",
        "f6_quality": f"SELECT count(*) AS total, count(*) FILTER ({GOOD}) AS good, count(*) FILTER (NOT ({GOOD})) AS rejected FROM threads",
        "f7_threshold": f"WITH {POSTS_SQL} SELECT tweet_id, jumlah_reply FROM posts WHERE hierarki_komentar = 'Root_Tweet' AND jumlah_reply >= 3",
        "f9_ids": f"SELECT count(*) FILTER (NOT regexp_full_match({nid('tweet_id')}, '[0-9]+')) AS not_digits, count(*) FILTER (regexp_matches({nid('tweet_id')}, {sq(SQL_SCIENTIFIC)})) AS scientific FROM legacy_import",
        "f10_seed_ids": f"WITH tok AS (SELECT unnest(string_split_regex(trim(url), '[\\s,;]+')) AS token FROM legacy_import WHERE url IS NOT NULL), x AS (SELECT CASE WHEN regexp_extract(token, {sq(SQL_SEED)}, 1) <> '' THEN regexp_extract(token, {sq(SQL_SEED)}, 1) ELSE token END AS seed_id FROM tok WHERE token <> '') SELECT DISTINCT seed_id, regexp_full_match(seed_id, '[0-9]{{6,}}') AS valid FROM x",
        "f11_pending": f"WITH {POSTS_SQL}, {STATES_SQL.format(src='posts')} SELECT tweet_id FROM posts WHERE hierarki_komentar = 'Root_Tweet' AND jumlah_reply >= 1 AND tweet_id NOT IN (SELECT root_tweet_id FROM states WHERE status IN ('all_exhausted', 'invalid_root', 'direct_exhausted'))",
        "f12_done_queries": "SELECT DISTINCT concat_ws('::', 'Latest', keyword_matched) AS k FROM legacy_import WHERE concat_ws('::', 'Latest', keyword_matched) NOT IN (SELECT concat_ws('::', 'Latest', keyword_matched) FROM threads WHERE jumlah_likes > 50)",
        "f13_ready": f"WITH {LABELLED_SQL} SELECT count(*) FILTER (trim(a1) <> '') AS n_filled, count(*) FILTER (a1 IN {CATS_SQL}) AS n_valid, count(*) FILTER (trim(a1) <> '') > 0 AND count(*) FILTER (a1 IN {CATS_SQL}) > 0 AS ready FROM lab",
        "f14_pairs": f"SELECT count(*) FILTER ({label_sql('annotator_1')} IN {CATS_SQL}) AS valid, count(*) FILTER ({label_sql('annotator_1')} NOT IN {CATS_SQL}) AS invalid FROM pilot_raw",
        "f15_search": f"WITH {MAP_SQL} SELECT * FROM vm WHERE contains(slang, 'an') OR contains(kata_baku, 'an')",
        "f16_abstention": f"WITH {SCORES_SQL} SELECT tweet_id, CASE WHEN confidence >= 0.6 AND margin >= 0.15 THEN 'ACCEPTED' ELSE 'NEEDS_REVIEW' END AS status FROM tt",
        "f18_eligible": f"WITH {CONTEXT_SQL} SELECT count(*) AS replies, count(*) FILTER (trim(coalesce(teks_root, '')) <> '' AND trim({txt()}) <> '') AS eligible FROM ctx",
        "j1_root_context": f"WITH {CONTEXT_SQL} SELECT tweet_id, root_tweet_id, teks_root FROM ctx",
        "j2_ambiguous_roots": "SELECT tweet_id, count(*) AS n FROM threads WHERE hierarki_komentar = 'Root_Tweet' GROUP BY 1 HAVING count(*) > 1",
        "j3_orphans": f"WITH {N_SQL} SELECT root_tweet_id, count(*) AS n FROM n WHERE hierarki_komentar = 'Direct_Reply' AND root_tweet_id NOT IN (SELECT tweet_id FROM n WHERE hierarki_komentar = 'Root_Tweet') GROUP BY 1",
        "j4_difference": "SELECT tweet_id, 'left_only' AS side FROM (SELECT tweet_id FROM pilot_raw EXCEPT SELECT tweet_id FROM coordinator_sampling) UNION ALL SELECT tweet_id, 'right_only' FROM (SELECT tweet_id FROM coordinator_sampling EXCEPT SELECT tweet_id FROM pilot_raw)",
        "j5_dedup": f"WITH {POSTS_SQL} SELECT tweet_id, jumlah_likes FROM posts",
        "j8_first_root_text": f"WITH {POSTS_SQL} SELECT tweet_id, teks_komentar FROM posts WHERE hierarki_komentar = 'Root_Tweet'",
        "j9_side_by_side": "WITH m AS (SELECT *, row_number() OVER (PARTITION BY tweet_id, slot ORDER BY marked_at DESC, mark DESC NULLS LAST) AS rn FROM annotation_marks) SELECT tweet_id, max(mark) FILTER (slot = 1 AND rn = 1) AS one, max(mark) FILTER (slot = 2 AND rn = 1) AS two FROM m GROUP BY 1",
        "j13_leakage": "SELECT root_tweet_id, count(DISTINCT sumber_akuisisi) AS n_parts FROM threads WHERE root_tweet_id IS NOT NULL AND tweet_id IS NOT NULL AND sumber_akuisisi IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sumber_akuisisi) > 1",
        "a1_audit": f"WITH {N_SQL}, o AS (SELECT count(*) AS orphans FROM n WHERE hierarki_komentar = 'Direct_Reply' AND root_tweet_id NOT IN (SELECT tweet_id FROM n WHERE hierarki_komentar = 'Root_Tweet')), x AS (SELECT (SELECT count(*) FROM (SELECT tweet_id FROM n WHERE tweet_id <> '' EXCEPT SELECT tweet_id FROM coordinator_sampling)) AS data_only, (SELECT count(*) FROM (SELECT tweet_id FROM coordinator_sampling EXCEPT SELECT tweet_id FROM n)) AS state_only) SELECT count(*) AS total_rows, count(DISTINCT nullif(tweet_id, '')) AS distinct_ids, count(*) FILTER (tweet_id <> '') - count(DISTINCT nullif(tweet_id, '')) AS duplicate_rows, count(*) FILTER ({bad}) AS invalid_ids, count(*) FILTER ({sci}) AS scientific_ids, " + ", ".join(f"count(*) FILTER (trim(coalesce({c}, '')) = '') AS blank_{c}" for c in ("tweet_id", "root_tweet_id", "waktu_posting", "username", "teks_komentar", "sumber_akuisisi", "hierarki_komentar")) + ", count(DISTINCT nullif(root_tweet_id, '')) AS distinct_roots, count(*) FILTER (hierarki_komentar = 'Root_Tweet') AS root_rows, count(*) FILTER (hierarki_komentar = 'Root_Tweet' AND NOT (tweet_id = root_tweet_id AND root_tweet_id = conversation_id AND in_reply_to_tweet_id = '')) AS bad_roots, count(*) FILTER (hierarki_komentar = 'Direct_Reply' AND NOT (in_reply_to_tweet_id = root_tweet_id AND root_tweet_id = conversation_id AND in_reply_to_tweet_id <> '' AND tweet_id <> '')) AS bad_direct, count(*) FILTER (hierarki_komentar = 'Nested_Reply' AND NOT (conversation_id = root_tweet_id AND in_reply_to_tweet_id <> '' AND in_reply_to_tweet_id <> root_tweet_id)) AS bad_nested, any_value(o.orphans) AS orphans, any_value(x.data_only) AS data_only, any_value(x.state_only) AS state_only FROM n, o, x",
        "a2_duplicates": "SELECT tweet_id, count(*) AS n_rows FROM threads WHERE trim(coalesce(tweet_id, '')) <> '' GROUP BY 1 HAVING count(*) > 1",
        "a3_reply_statistics": f"WITH {REPLIES_SQL} SELECT min(n_replies)::DOUBLE AS min, max(n_replies)::DOUBLE AS max, avg(n_replies) AS mean, stddev_samp(n_replies) AS std, " + ", ".join(f"quantile_cont(n_replies::DOUBLE, {x}::DOUBLE) AS q{int(x * 100)}" for x in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM rep",
        "a2_dataset": f"WITH {REPLIES_SQL}, ids AS (SELECT count(*) AS distinct_ids, count(*) FILTER (k > 1) AS repeated_ids FROM (SELECT tweet_id, count(*) AS k FROM n GROUP BY 1)), st AS (SELECT count(*) AS roots_with_replies, coalesce(min(n_replies), 0)::DOUBLE AS min, coalesce(max(n_replies), 0)::DOUBLE AS max, coalesce(avg(n_replies), 0) AS mean, coalesce(stddev_samp(n_replies), 0) AS std, " + ", ".join(f"coalesce(quantile_cont(n_replies::DOUBLE, {x}::DOUBLE), 0) AS q{int(x * 100)}" for x in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM rep), m AS (SELECT count(*) AS total_rows, count(*) FILTER (hierarki_komentar = 'Root_Tweet') AS root_rows, count(*) FILTER (hierarki_komentar = 'Direct_Reply') AS direct_rows, count(*) FILTER (hierarki_komentar = 'Nested_Reply') AS nested_rows, bool_and(hierarki_komentar <> 'Root_Tweet' OR hierarki_komentar IS NULL OR (tweet_id = root_tweet_id AND tweet_id = conversation_id AND in_reply_to_tweet_id = '')) AS roots_ok, bool_and(hierarki_komentar <> 'Direct_Reply' OR hierarki_komentar IS NULL OR (in_reply_to_tweet_id = root_tweet_id AND conversation_id = root_tweet_id)) AS direct_ok, count(*) FILTER (coalesce(teks_komentar, '') = '') AS missing_text, count(*) FILTER (hierarki_komentar = 'Direct_Reply' AND root_tweet_id NOT IN (SELECT tweet_id FROM n WHERE hierarki_komentar = 'Root_Tweet')) AS orphans FROM n) SELECT * FROM m, ids, st",
        "a4_heavy_roots": f"WITH {REPLIES_SQL} SELECT * FROM rep WHERE n_replies >= 50",
        "a5_distribution": "SELECT CASE WHEN trim(coalesce(sumber_akuisisi, '')) = '' THEN '(kosong)' ELSE sumber_akuisisi END AS value, count(*) AS n FROM threads GROUP BY 1",
        "a9_frame": f"WITH l AS (SELECT *, {label_sql('annotator_1')} AS label FROM pilot_raw), z AS (SELECT count(*) AS n_rows, count(*) - count(DISTINCT coalesce(tweet_id, '')) AS n_duplicates, coalesce((SELECT string_agg(DISTINCT label, '|' ORDER BY label) FROM l WHERE label NOT IN {CATS_SQL}), '') AS invalid_labels, (SELECT count(DISTINCT label) FROM l WHERE label NOT IN {CATS_SQL}) AS k, count(*) FILTER (trim({txt()}) = '') AS n_empty, count(DISTINCT root_tweet_id) AS n_roots FROM l) SELECT n_rows, n_duplicates, invalid_labels, n_empty, n_roots, n_duplicates = 0 AND k = 0 AND n_empty = 0 AS is_valid FROM z",
        "a11_vocabulary": f"WITH {TOKENS_SQL} SELECT token, n FROM vocab",
        "a12_candidates": f"WITH {MAP_SQL}, {TOKENS_SQL}, c AS (SELECT m1.slang, m1.kata_baku, v.n FROM m1 JOIN vocab v ON v.token = m1.slang WHERE m1.p0 IS NULL) SELECT slang, CASE WHEN count(DISTINCT kata_baku) = 1 THEN min(kata_baku) END AS kata_baku, count(DISTINCT kata_baku) AS n_targets, max(n) AS frekuensi, count(DISTINCT kata_baku) > 1 AS conflict FROM c GROUP BY slang",
        "a13_coverage": f"WITH {MAP_SQL}, r AS (SELECT row_number() OVER () AS row_, {txt()} AS t FROM threads), tk AS (SELECT row_, unnest(regexp_extract_all(lower(t), {sq(SQL_TOKEN)})) AS token FROM r), f AS (SELECT tk.* FROM tk JOIN vm ON vm.slang = tk.token) SELECT count(DISTINCT token) AS n_entries_seen, count(*) AS n_tokens, count(DISTINCT row_) AS n_rows FROM f",
        "a14_summary": f"WITH {SENT_SQL} SELECT '*' AS summary, {SUM_COLS} FROM sent",
        "a15_grouped_summary": f"WITH {SENT_SQL} SELECT '*' AS summary, {SUM_COLS} FROM sent UNION ALL SELECT keyword, {SUM_COLS} FROM sent GROUP BY keyword",
        "a16_reconcile": f"WITH t AS (SELECT *, trim({txt('tweet_id')}) <> '' AND trim({txt()}) <> '' AND trim({txt('sumber_akuisisi')}) <> '' AND trim({txt('hierarki_komentar')}) <> '' AS ok FROM threads), v AS (SELECT * FROM t WHERE ok) SELECT (SELECT count(*) FROM (SELECT tweet_id FROM coordinator_sampling EXCEPT SELECT tweet_id FROM v)) AS removed, (SELECT count(*) FROM (SELECT tweet_id FROM v EXCEPT SELECT tweet_id FROM coordinator_sampling)) AS added, (SELECT count(DISTINCT tweet_id) FROM v WHERE hierarki_komentar = 'Root_Tweet' AND coalesce(jumlah_reply, 0) >= 3 AND tweet_id NOT IN (SELECT tweet_id FROM pilot_raw)) AS recovered, (SELECT count(*) FROM t WHERE NOT ok) AS invalid, (SELECT count(DISTINCT tweet_id) FROM v) AS total",
        "a17_import_counts": f"WITH {IMPORT_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (eligible) AS eligible FROM st2",
        "a18_root_coverage": "WITH n AS (SELECT root_tweet_id, count(*) AS n FROM pilot_raw GROUP BY 1) SELECT count(*) AS n_roots, max(n) AS most, min(n) AS least, avg(n) AS mean, quantile_cont(n::DOUBLE, 0.5::DOUBLE) AS median FROM n",
        "a20_progress": f"WITH {ADJ_SQL} SELECT count(*) AS n_items, count(*) FILTER (state = 'SETUJU') AS agreed, count(*) FILTER (state = 'BEDA') AS different, count(*) FILTER (final_status IN ('SIAP', 'ADJUDICATED')) AS final_ready FROM s3",
        "o1_top_users": "SELECT username AS value, count(*) AS n FROM threads WHERE username IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5",
        "o2_rank": f"WITH {MAP_SQL}, s AS (SELECT *, CASE WHEN length(slang) > 4 THEN 'elongation' ELSE 'review' END AS source FROM vm) SELECT * FROM s ORDER BY frekuensi DESC, source = 'elongation', source <> 'review', slang LIMIT 30",
        "o3_quota": "SELECT tweet_id FROM threads ORDER BY captured_at, tweet_id, root_tweet_id NULLS FIRST LIMIT 500",
        "o6_shuffle": "SELECT tweet_id FROM (SELECT DISTINCT tweet_id FROM pilot_raw) ORDER BY md5('20260907|' || tweet_id) LIMIT 100",
        "w1_position": f"WITH {POSTS_SQL} SELECT tweet_id, root_tweet_id, row_number() OVER (PARTITION BY root_tweet_id ORDER BY md5('7|' || tweet_id)) AS position FROM posts",
        "w4_strata": "WITH h AS (SELECT list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{k}' END" for k, e in STRATUM.items()) + "], lambda x: x IS NOT NULL) AS m FROM threads) SELECT CASE WHEN len(m) = 0 THEN 'No_Signal' WHEN len(m) = 1 THEN m[1] || '_Signal' ELSE 'Overlap' END AS stratum, coalesce(array_to_string(m, ','), '') AS reason, count(*) AS n FROM h GROUP BY 1, 2",
        "x1_sets": "SELECT tweet_id FROM coordinator_sampling INTERSECT SELECT tweet_id FROM pilot_raw",
        "x2_union": "SELECT tweet_id, count(*) AS n FROM (SELECT tweet_id FROM pilot_raw UNION ALL SELECT tweet_id FROM removal_log) GROUP BY 1",
        "x3_ordered_distinct": "WITH k AS (SELECT lower(trim(keyword_matched)) AS key, trim(keyword_matched) AS value, row_number() OVER (PARTITION BY lower(trim(keyword_matched)) ORDER BY captured_at, tweet_id, trim(keyword_matched)) AS rn FROM threads WHERE trim(keyword_matched) <> '') SELECT key, value FROM k WHERE rn = 1",
        "g1_split": f"WITH {split_cte} SELECT root_tweet_id, part FROM parts",
        "g3_folds": f"WITH {POSTS_SQL} SELECT DISTINCT root_tweet_id, {hashed.format(repr('42|') + ' || root_tweet_id')} % 5 AS fold FROM posts",
        "g4_no_leakage": f"WITH {split_cte} SELECT root_tweet_id, count(DISTINCT part) AS n_parts FROM posts JOIN parts USING (root_tweet_id) GROUP BY 1 HAVING count(DISTINCT part) > 1",
        "t1_cleanse": outs(cleaned()),
        "t1_cleanse_remove": outs(cleaned(url=" ", mention=r"\1 ")),
        "t1_cleanse_keep": outs(cleaned(lower=False, url=None, mention=None)),
        "t4_no_emoji": outs(cleaned(emoji=False)),
        "t5_no_punctuation": outs(cleaned(emoji=False, punctuation=False)),
        "t6_normalize": f"WITH {MAP_SQL} SELECT tweet_id, coalesce(array_to_string(list_transform(regexp_extract_all({txt()}, {sq('(?i)(' + SQL_TOKEN + '|[^a-z0-9]+)')}), lambda x: coalesce(m[lower(x)], x)), ''), '') AS out FROM threads, mp",
        "t7_model_text": f"WITH {MAP_SQL}, a AS (SELECT tweet_id, m, regexp_replace(regexp_replace(lower(nfc_normalize({txt()})), {sq(SQL_HTTP)}, 'URL', 'g'), {sq(SQL_HANDLE)}, 'USER', 'g') AS t FROM threads, mp), b AS (SELECT tweet_id, {MAPPED('t')} AS t FROM a) SELECT tweet_id, {collapsed(NOSTOP('t'))} AS out FROM b",
        "t8_slang_words": f"WITH {MAP_SQL} SELECT tweet_id, {MAPPED(txt())} AS out FROM threads, mp",
        "t10_stopwords": outs(NOSTOP(txt())),
        "t11_nfc": "SELECT doc_id, nfc_normalize(coalesce(text, '')) AS out FROM documents",
        "t16_pair_text": f"WITH a AS (SELECT tweet_id, {collapsed('nfc_normalize(' + txt('teks_root') + ')')} AS r, {collapsed('nfc_normalize(' + txt() + ')')} AS t FROM pilot_raw) SELECT tweet_id, CASE WHEN r <> '' THEN r || ' [SEP] ' || t ELSE t END AS out FROM a",
        "t17_search_query": f"WITH k AS (SELECT DISTINCT trim(keyword_matched) AS t FROM (SELECT DISTINCT keyword_matched FROM threads WHERE keyword_matched IS NOT NULL)), q AS (SELECT CASE WHEN contains(t, ' ') AND NOT starts_with(t, '\"') AND NOT regexp_matches(t, {sq(SQL_BOOLEAN)}) THEN '\"' || t || '\"' ELSE t END AS t FROM k) SELECT concat_ws(' ', t, CASE WHEN NOT contains(lower(t), '-filter:links') THEN '-filter:links' END, CASE WHEN NOT contains(lower(t), '-filter:media') THEN '-filter:media' END) AS out FROM q",
        "t22_retry": outs(f"CASE WHEN contains(lower({txt()}), 'rate') OR contains(lower({txt()}), '429') OR contains(lower({txt()}), 'no account available') THEN 120 ELSE 15 END"),
        "t23_stamps": "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S+07:00') AS at FROM events",
        "proj3_ids": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey END::VARCHAR AS id FROM orders",
        "t23_months": "SELECT strftime(try_cast(nullif(trim(waktu_posting), '') AS TIMESTAMPTZ), '%Y-%m') AS month, count(*) AS n FROM threads GROUP BY 1",
        "t25_progress": outs(f"least(coalesce(try_cast(regexp_replace(regexp_extract({txt()}, '([0-9][0-9.,]*)', 1), '[.,]', '', 'g') AS BIGINT) * 100.0::DOUBLE / 1000.0, 0.0), 100.0)"),
        "t26_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "t27_arrays": "SELECT root_tweet_id, string_agg(DISTINCT tweet_id, ',' ORDER BY tweet_id) AS members FROM pilot_raw GROUP BY 1",
        "t28_margin": f"WITH {SCORES_SQL} SELECT tweet_id, best, confidence, margin FROM tt",
        "t29_percent": "SELECT bahasa, count(*) FILTER (jumlah_likes > 10) * 100.0 / count(*) AS pct FROM threads GROUP BY 1",
        "m1_class_metrics": f"WITH {CLASS_SQL} SELECT label, precision, recall, f1, support FROM cls",
        "m1_overall": f"WITH {CLASS_SQL} SELECT (SELECT count(*) FILTER (t = p) / count(*) FROM pred) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, (SELECT avg(r) FROM (SELECT count(*) FILTER (t = p) / count(*) AS r FROM pred GROUP BY t)) AS balanced_accuracy FROM cls",
        "m2_bootstrap": f"WITH {PRED_SQL}, grp AS (SELECT root_tweet_id, row_number() OVER (ORDER BY md5(root_tweet_id), root_tweet_id) - 1 AS g, " + ", ".join(f"count(*) FILTER (t = '{c}' AND p = '{c}') AS tp{i}, count(*) FILTER (p = '{c}') AS told{i}, count(*) FILTER (t = '{c}') AS real{i}" for i, c in enumerate(['Mutu_Gizi', 'Tata_Kelola', 'Distribusi'])) + f" FROM pred GROUP BY root_tweet_id), sz AS (SELECT count(*) AS size FROM grp), dr AS (SELECT b, {hashed.format(repr('42|') + ' || b || ' + repr('|') + ' || i')} % size AS g, size FROM sz, range(200) bb(b), LATERAL (SELECT unnest(range(size)) AS i)), sm AS (SELECT b, " + ", ".join(f"sum({k}{i}) AS {k}{i}" for i in range(3) for k in ("tp", "told", "real")) + " FROM dr JOIN grp USING (g) GROUP BY b), s AS (SELECT (" + " + ".join(f"CASE WHEN told{i} + real{i} > 0 THEN 2.0::DOUBLE * tp{i} / (told{i} + real{i}) ELSE 0 END" for i in range(3)) + ") / 3 AS s FROM sm) SELECT avg(s) AS mean, stddev_pop(s) AS std, quantile_cont(s, 0.025::DOUBLE) AS low, quantile_cont(s, 0.975::DOUBLE) AS high FROM s",
        "m3_kappa": f"WITH {LABELLED_SQL}, c AS (SELECT a1, a2 FROM lab WHERE a1 <> '' AND a2 <> ''), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a1 = a2)::DOUBLE AS ag FROM c), x AS (SELECT sum(l.n * r.n)::DOUBLE AS cross_ FROM (SELECT a1 AS k, count(*) AS n FROM c GROUP BY 1) l JOIN (SELECT a2 AS k, count(*) AS n FROM c GROUP BY 1) r USING (k)) SELECT n, ag / n AS agreement, (ag / n - cross_ / (n * n)) / (1 - cross_ / (n * n)) AS kappa FROM n, x",
        "m3_matrix": f"WITH {PRED_SQL} SELECT x.label AS a, y.label AS b, (SELECT count(*) FROM lab WHERE a1 = x.label AND a2 = y.label) AS n FROM labels x, labels y",
        "m5_per_root": f"WITH {PRED_SQL}, f AS (SELECT root_tweet_id, label, CASE WHEN count(*) FILTER (p = label) + count(*) FILTER (t = label) > 0 THEN 2.0::DOUBLE * count(*) FILTER (t = label AND p = label) / (count(*) FILTER (p = label) + count(*) FILTER (t = label)) ELSE 0 END AS f1 FROM pred, labels GROUP BY 1, 2) SELECT root_tweet_id, sum(f1) / 3 AS macro_f1 FROM f GROUP BY 1",
        "m6_gates": f"WITH {CLASS_SQL}, o AS (SELECT avg(f1) AS macro_f1, min(recall) AS least, (SELECT avg(r) FROM (SELECT count(*) FILTER (t = p) / count(*) AS r FROM pred GROUP BY t)) AS bal FROM cls) SELECT CASE WHEN macro_f1 >= 0.85 THEN 'pass' ELSE 'fail' END AS macro_f1, CASE WHEN least >= 0.8 THEN 'pass' ELSE 'fail' END AS class_recall, CASE WHEN bal >= 0.85 THEN 'pass' ELSE 'fail' END AS balanced_accuracy, 'not_evaluated' AS val_test_gap, 'pass' AS zero_root_leakage FROM o",
        "m20_row_check": f"SELECT CASE WHEN {empty} AND trim(coalesce(annotation_status, '')) = '' THEN '' WHEN ({empty} AND trim(coalesce(annotation_status, '')) = 'UNCLEAR') OR (trim(coalesce(annotation_status, '')) = 'LABELED' AND ({pairs}) AND (trim(coalesce(kategori_sekunder, '')) = '' OR (trim(kategori_sekunder) IN {CATS_SQL} AND trim(kategori_sekunder) <> trim(kategori_utama)))) THEN 'OK' ELSE 'PERIKSA' END AS state, count(*) AS n FROM pilot_raw GROUP BY 1",
        "m21_adjudication": f"WITH {ADJ_SQL} SELECT tweet_id, state, final_label, final_status FROM s3",
        "m11_most_frequent": f"WITH {LABELLED_SQL} SELECT a1, count(*) AS n FROM lab WHERE a1 IN {CATS_SQL} GROUP BY 1 ORDER BY n DESC, a1 LIMIT 1",
        "m22_keyword_labels": f"WITH {LABELLED_SQL}, h AS (SELECT tweet_id, list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{k}' END" for k, e in STRATUM.items()) + "], lambda x: x IS NOT NULL) AS m FROM lab) SELECT tweet_id, CASE WHEN len(m) = 1 THEN m[1] END AS prediction FROM h",
        "r1_discover": f"WITH {N_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY captured_at, root_tweet_id, jumlah_likes) AS rn FROM n) SELECT CASE WHEN rn > 1 THEN 'dedup' WHEN NOT ({ROOT_SQL}) THEN 'root' WHEN {LANG.format('bahasa')} <> 'in' THEN 'language' WHEN NOT ({GOOD}) THEN 'quality' END AS reason, count(*) AS n FROM o GROUP BY 1",
        "r3_deferred": f"WITH {N_SQL}, lv AS (SELECT *, {LEVEL_SQL} AS level FROM n), v AS (SELECT DISTINCT tweet_id FROM lv WHERE level = 'Root_Tweet' AND {ROOT_SQL}) SELECT DISTINCT tweet_id FROM lv WHERE level IN ('Direct_Reply', 'Nested_Reply') AND root_tweet_id IN (SELECT tweet_id FROM v)",
        "r4_root_states": f"WITH {N_SQL}, {STATES_SQL.format(src='n')} SELECT root_tweet_id, status FROM states",
        "r9_stream_distinct": "SELECT DISTINCT tweet_id FROM threads",
        "r_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    }
    seeds = sql["f10_seed_ids"].replace(" SELECT DISTINCT seed_id", ", q AS (SELECT DISTINCT seed_id")
    sql["f10_queue_seeds"] = f"{seeds}), {POSTS_SQL}, rt AS (SELECT tweet_id, coalesce(keyword_matched, '') AS keyword_matched FROM posts WHERE hierarki_komentar = 'Root_Tweet') SELECT * FROM rt UNION ALL SELECT seed_id, 'MANUAL_SEED' FROM q WHERE valid AND seed_id NOT IN (SELECT tweet_id FROM rt)"
    sql["m4_category_kappa"] = f"WITH {LABELLED_SQL}, c AS (SELECT * FROM lab WHERE a1 <> '' AND a2 <> ''), k AS (SELECT count(*) AS n, count(*) FILTER (a1 = a2) AS agreed, (" + " + ".join(f"count(*) FILTER (a1 = '{c}') * count(*) FILTER (a2 = '{c}')" for c in ('Mutu_Gizi', 'Tata_Kelola', 'Distribusi')) + ")::DOUBLE AS x FROM c), z AS (SELECT n, agreed, (agreed / n - x / (n * n)) / (1 - x / (n * n)) AS kappa FROM k) SELECT n, agreed, kappa, CASE WHEN kappa IS NULL THEN 'BELUM ADA DATA' WHEN kappa >= 0.8 THEN 'LULUS' ELSE 'REVISI PANDUAN' END AS gate FROM z"
    sql["proj10_blind"] = "SELECT tweet_id, root_tweet_id, teks_root, teks_komentar, " + ", ".join(f"'' AS {c}" for c in ("kategori_utama", "subkategori_primer", "kategori_sekunder", "annotation_status", "annotator_1", "annotator_2", "adjudicated_label")) + ", '2.0' AS label_guide_version FROM pilot_raw"
    sql["proj13_label_map"] = f"WITH {LABELLED_SQL}, l AS (SELECT DISTINCT a1 AS label FROM lab) SELECT label, row_number() OVER (ORDER BY label) - 1 AS index FROM l"
    sql["f8_required"] = "SELECT " + ", ".join(f"count(*) FILTER (trim(coalesce({c}, '')) = '') AS {c}" for c in ("tweet_id", "teks_komentar", "sumber_akuisisi", "hierarki_komentar")) + " FROM threads"
    sql["a6_sorted_counter"] = "SELECT CASE WHEN trim(coalesce(bahasa, '')) = '' THEN '(kosong)' ELSE bahasa END AS value, count(*) AS n FROM threads GROUP BY 1 ORDER BY n DESC, value"
    sql["a8_source_audit"] = f"SELECT total_rows, distinct_ids, invalid_ids, orphans, (SELECT count(*) FROM threads WHERE coalesce(hierarki_komentar, '') NOT IN ('Root_Tweet', 'Direct_Reply', 'Nested_Reply')) AS open_levels FROM ({sql['a1_audit']})"
    sql["r3_stream_deferred"] = sql["r3_deferred"]
    broken = {"empty": "total_rows = 0", "duplicates": "duplicate_rows > 0", "invalid_ids": "invalid_ids > 0", "scientific_ids": "scientific_ids > 0", "bad_roots": "bad_roots > 0", "bad_direct": "bad_direct > 0", "bad_nested": "bad_nested > 0", "orphans": "orphans > 0", "blank_text": "blank_teks_komentar > 0"}
    listed = "list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in broken.items()) + "], lambda x: x IS NOT NULL)"
    sql["a7_contract"] = f"SELECT coalesce(array_to_string({listed}, ','), '') AS broken, len({listed}) = 0 AS ok FROM ({sql['a1_audit']})"
    value = f"lower({collapsed(txt('kata_baku'))})"
    step = lambda e: f"coalesce(array_to_string(list_transform(string_split({e}, ' '), lambda x: CASE x WHEN 'nggak' THEN 'tidak' WHEN 'gak' THEN 'nggak' WHEN 'udah' THEN 'sudah' ELSE x END), ' '), '')"
    for _ in range(4):
        value = step(value)
    sql["t19_canonical"] = f"SELECT DISTINCT CASE WHEN {step(value)} = {value} THEN {value} END AS out FROM slang_map"
    squeezed = lambda c: f"array_to_string(list_filter(string_split({c}, ''), lambda x, i: i = 1 OR x <> {c}[i - 1]), '')"
    sql["t20_elongations"] = f"WITH {TOKENS_SQL}, base AS (SELECT token FROM vocab WHERE n > 200), known AS (SELECT {squeezed('token')} AS key, min(token) AS target FROM base GROUP BY 1 HAVING count(DISTINCT token) = 1), w AS (SELECT token, n, {squeezed('token')} AS key FROM vocab WHERE regexp_full_match(token, '[a-z]{{4,}}') AND token NOT IN (SELECT token FROM base)) SELECT w.token AS slang, known.target AS kata_baku, w.n AS frekuensi FROM w JOIN known USING (key) WHERE length(w.key) < length(w.token) AND w.token <> known.target"
    cell = "floor((confidence - 0.4::DOUBLE) / 0.05::DOUBLE + 1e-9) >= ci AND floor((margin - 0.05::DOUBLE) / 0.05::DOUBLE + 1e-9) >= mi"
    sql["m7_calibration"] = f"WITH {PRED_SQL}, g AS (SELECT * FROM range(10) a(ci), range(5) b(mi)), acc AS (SELECT g.ci, g.mi, pred.t, pred.p FROM g, pred WHERE {cell}), cov AS (SELECT ci, mi, count(*) / (SELECT count(*) FROM pred) AS coverage FROM acc GROUP BY 1, 2), f AS (SELECT ci, mi, label, CASE WHEN count(*) FILTER (p = label) + count(*) FILTER (t = label) > 0 THEN 2.0::DOUBLE * count(*) FILTER (t = label AND p = label) / (count(*) FILTER (p = label) + count(*) FILTER (t = label)) ELSE 0 END AS f1 FROM acc, labels GROUP BY 1, 2, 3), m AS (SELECT ci, mi, avg(f1) AS macro_f1 FROM f GROUP BY 1, 2) SELECT 0.4::DOUBLE + ci * 0.05::DOUBLE AS confidence_threshold, 0.05::DOUBLE + mi * 0.05::DOUBLE AS margin_threshold, coverage, macro_f1, row_number() OVER (ORDER BY round(macro_f1, 12) DESC, ci, mi) = 1 AND macro_f1 > 0 AS best FROM cov JOIN m USING (ci, mi) WHERE coverage > 0.1"
    hits = "list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{k}' END" for k, e in STRATUM.items()) + "], lambda x: x IS NOT NULL)"
    ctes = [POSTS_SQL, f"fr AS MATERIALIZED (SELECT tweet_id, root_tweet_id, CASE len(m) WHEN 0 THEN 'No_Signal' WHEN 1 THEN m[1] || '_Signal' ELSE 'Overlap' END AS stratum FROM (SELECT *, {hits} AS m FROM posts WHERE hierarki_komentar = 'Direct_Reply' AND root_tweet_id <> ''))", "ch0 AS (SELECT tweet_id, root_tweet_id, stratum, '' AS stage FROM fr WHERE false)"]
    for i, stage in enumerate([*SQL_STRATA, "~rest~"], 1):
        rest = stage == "~rest~"
        h = lambda c, s=stage: f"md5('20260907|{s}|' || {c})"
        order = f"{h('root_tweet_id')}, root_tweet_id, k" if rest else f"k, {h('root_tweet_id')}, root_tweet_id"
        where = "" if rest else f"f.stratum = '{stage}' AND "
        want = f"(SELECT {'300 - count(*)' if rest else 'least(60, 300 - count(*))'} FROM ch{i - 1})"
        ctes += [
            f"rk{i} AS (SELECT f.*, coalesce(u.n, 0) AS used, row_number() OVER (PARTITION BY f.root_tweet_id ORDER BY {h('f.tweet_id')}, f.tweet_id) AS k FROM fr f LEFT JOIN (SELECT root_tweet_id, count(*) AS n FROM ch{i - 1} GROUP BY 1) u ON u.root_tweet_id = f.root_tweet_id WHERE {where}f.tweet_id NOT IN (SELECT tweet_id FROM ch{i - 1}))",
            f"ch{i} AS MATERIALIZED (SELECT * FROM ch{i - 1} UNION ALL SELECT tweet_id, root_tweet_id, stratum, '{stage}' FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS at_ FROM rk{i} WHERE k <= 5 - used) WHERE at_ <= {want})",
        ]
    # the whole permutation and all replicates; the SQL of the smaller queries stays as it is
    sql["o6_shuffle_all"] = sql["o6_shuffle"].removesuffix(" LIMIT 100")
    sql["m2_bootstrap_1000"] = sql["m2_bootstrap"].replace("range(200)", "range(1000)")
    sql["w2_pilot_sample"] = "WITH " + ", ".join(ctes) + " SELECT * FROM ch6"
    return sql
