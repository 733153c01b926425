"""Evaluation: class metrics, bootstrap by thread, agreement, gates, threshold calibration, annotation states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benang.functions.text import text_or_blank

LABELS = ["Mutu_Gizi", "Tata_Kelola", "Distribusi"]
# fixed values: acceptance thresholds
GATES = {"macro_f1": 0.85, "class_recall": 0.80, "balanced_accuracy": 0.85, "val_test_gap": 0.05}
# fixed values: subcategories of each category
TAXONOMY = {
    "Mutu_Gizi": ["Kecukupan_Porsi_dan_Nutrisi", "Variasi_dan_Rasa_Menu", "Keamanan_Konsumsi"],
    "Tata_Kelola": ["Standardisasi_Vendor_dan_Dapur", "Transparansi_dan_Efisiensi_Anggaran", "Responsivitas_Aduan"],
    "Distribusi": ["Ketepatan_Waktu_Logistik", "Pemerataan_Jangkauan_3T", "Kondisi_Fisik_dan_Pembagian"],
}


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, true: str, pred: str, *by: str) -> DataFrame:
    return df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(cm: DataFrame, labels: list[str] = LABELS, *by: str) -> DataFrame:
    """Precision, recall, F1 and support of every listed label (0 where undefined), from a confusion table."""
    each = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    cells = cm.select(*by, "true", "pred", "n", each)
    n = F.col("n")
    hit, told, real = F.sum(F.when((F.col("true") == F.col("label")) & (F.col("pred") == F.col("label")), n).otherwise(0)), F.sum(F.when(F.col("pred") == F.col("label"), n).otherwise(0)), F.sum(F.when(F.col("true") == F.col("label"), n).otherwise(0))
    per = cells.groupBy(*by, "label").agg(hit.alias("tp"), told.alias("told"), real.alias("support"))
    p, r = ratio(F.col("tp"), F.col("told")), ratio(F.col("tp"), F.col("support"))
    return per.select(*by, "label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def overall(cm: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Accuracy, macro averages over all listed labels, and balanced accuracy: mean recall over the classes that
    stand in the truth."""
    m = class_metrics(cm, labels).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    from benang.operators.relations import one_row

    recalls = cm.groupBy("true").agg(ratio(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("recall"))
    acc = cm.agg(ratio(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return one_row(acc, m, recalls.agg(F.avg("recall").alias("balanced_accuracy")))


def per_group_f1(df: DataFrame, true: str, pred: str, group: str, labels: list[str] = LABELS) -> DataFrame:
    """Macro-F1 per group over the fixed labels; a label that is absent counts 0."""
    return class_metrics(confusion(df, true, pred, group), labels, group).groupBy(group).agg((F.sum("f1") / len(labels)).alias("macro_f1"))


def bootstrap(df: DataFrame, true: str, pred: str, group: str, replicates: int = 1000, level: float = 0.95, seed: str = "42", labels: list[str] = LABELS) -> DataFrame:
    """Mean, population deviation and percentile interval of macro-F1 over draws of whole groups with replacement.

    Rows are never copied: each group is three counts per label. The number of times a group is drawn comes from
    hashes, so that SQL can draw the same: draw i of replicate b takes group number hash(b, i) mod groups."""
    n = F.lit(1)
    parts = []
    for i, lab in enumerate(labels):
        parts += [F.sum(F.when((F.col(true) == lab) & (F.col(pred) == lab), n).otherwise(0)).alias(f"tp{i}"), F.sum(F.when(F.col(pred) == lab, n).otherwise(0)).alias(f"told{i}"), F.sum(F.when(F.col(true) == lab, n).otherwise(0)).alias(f"real{i}")]
    from benang.operators.pilot import hash_positions

    counts = df.groupBy(group).agg(*parts)
    size = counts.count()
    groups = hash_positions(counts, [], F.md5(F.col(group)), group, "g").withColumn("g", F.col("g") - 1)
    if not size:
        return groups.sparkSession.createDataFrame([], "mean double, std double, low double, high double")
    spark = df.sparkSession
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), (F.col("id") / size).cast("long").cast("string"), (F.col("id") % size).cast("string"))), 1, 8), 16, 10).cast("long")
    draws = spark.range(replicates * size).select((F.col("id") / size).cast("long").alias("b"), (h % size).cast("int").alias("g")).groupBy("b", "g").agg(F.count(F.lit(1)).alias("times"))
    sums = draws.join(groups, "g").groupBy("b").agg(*[F.sum(F.col("times") * F.col(f"{k}{i}")).alias(f"{k}{i}") for i in range(len(labels)) for k in ("tp", "told", "real")])
    f1 = [ratio(2 * F.col(f"tp{i}"), F.col(f"told{i}") + F.col(f"real{i}")) for i in range(len(labels))]
    score = sum(f1[1:], f1[0]) / len(labels)
    a = (1 - level) / 2
    return sums.select(score.alias("s")).agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.percentile("s", F.lit(a)).alias("low"), F.percentile("s", F.lit(1 - a)).alias("high"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement rate and Cohen's kappa over complete pairs and all labels seen."""
    pairs = df.where((text_or_blank(F.col(a)) != "") & (text_or_blank(F.col(b)) != "")).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    left, right = pairs.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na")), pairs.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    from benang.operators.relations import one_row

    both = left.join(right, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).cast("double").alias("cross"))
    out = one_row(pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("agreed")), both)
    po, pe = F.try_divide(F.col("agreed").cast("double"), F.col("n").cast("double")), F.try_divide(F.col("cross"), (F.col("n") * F.col("n")).cast("double"))
    return out.select("n", po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def agreement_matrix(df: DataFrame, a: str, b: str, labels: list[str] = LABELS) -> DataFrame:
    """How often the first annotator's label met the second's, for every pair of the listed labels (0 where never)."""
    met = df.where(F.col(a).isin(*labels) & F.col(b).isin(*labels)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cells = met.sparkSession.createDataFrame([(x, y) for x in labels for y in labels], "a string, b string")
    return cells.join(met, ["a", "b"], "left").na.fill(0, ["n"])


def gates(metrics: DataFrame, limits: dict[str, float] = GATES) -> DataFrame:
    """pass, fail or not_evaluated per gate; the limits themselves pass. Takes one row with macro_f1, least_recall,
    balanced_accuracy, val_macro_f1, test_macro_f1, n_leaks (null where unknown)."""
    def state(ok: Column) -> Column:
        return F.when(ok.isNull(), "not_evaluated").when(ok, "pass").otherwise("fail")

    gap = F.abs(F.col("val_macro_f1") - F.col("test_macro_f1"))
    return metrics.select(
        state(F.col("macro_f1") >= limits["macro_f1"]).alias("macro_f1"), state(F.col("least_recall") >= limits["class_recall"]).alias("class_recall"), state(F.col("balanced_accuracy") >= limits["balanced_accuracy"]).alias("balanced_accuracy"),
        state(gap <= limits["val_test_gap"]).alias("val_test_gap"), state(F.col("n_leaks") == 0).alias("zero_root_leakage"),
    )


def abstention(confidence: Column, margin: Column | None = None, least: float = 0.6, least_margin: float = 0.15) -> Column:
    ok = confidence >= least if margin is None else (confidence >= least) & (margin >= least_margin)
    return F.when(ok, "ACCEPTED").otherwise("NEEDS_REVIEW")


def calibration_grid(df: DataFrame, true: str, pred: str, confidence: str, margin: str, labels: list[str] = LABELS, least_coverage: float = 0.1) -> DataFrame:
    """Coverage and macro-F1 of accepted rows for thresholds 0.40..0.85 by 0.05 and 0.05..0.25 by 0.05, with the first
    best cell marked. Rows become counts per highest cell they pass, so the grid meets counts, not rows."""
    steps = lambda c, low, n: F.least(F.greatest(F.floor((c - low) / 0.05 + 1e-9).cast("int"), F.lit(-1)), F.lit(n - 1))
    cells = df.select(F.col(true).alias("true"), F.col(pred).alias("pred"), steps(F.col(confidence), 0.4, 10).alias("ci"), steps(F.col(margin), 0.05, 5).alias("mi")).groupBy("true", "pred", "ci", "mi").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    cells = cells.withColumn("total", total).where("ci >= 0 and mi >= 0")
    spread = cells.withColumn("conf_i", F.explode(F.sequence(F.lit(0), F.col("ci")))).withColumn("marg_i", F.explode(F.sequence(F.lit(0), F.col("mi"))))
    per = spread.groupBy("conf_i", "marg_i", "true", "pred").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
    cover = per.groupBy("conf_i", "marg_i").agg((F.sum("n") / F.max("total")).alias("coverage")).where(F.col("coverage") > least_coverage)
    f1 = class_metrics(per, labels, "conf_i", "marg_i").groupBy("conf_i", "marg_i").agg(F.avg("f1").alias("macro_f1"))
    grid = cover.join(f1, ["conf_i", "marg_i"])
    best = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(F.round("macro_f1", 12)), "conf_i", "marg_i")) == 1
    return grid.select((F.lit(0.4) + F.col("conf_i") * 0.05).alias("confidence_threshold"), (F.lit(0.05) + F.col("marg_i") * 0.05).alias("margin_threshold"), "coverage", "macro_f1", (best & (F.col("macro_f1") > 0)).alias("best"))


def valid_pair(category: Column, sub: Column) -> Column:
    ok = F.lit(False)
    for c, subs in TAXONOMY.items():
        ok = ok | ((category == c) & sub.isin(*subs))
    return ok


def row_check(df: DataFrame) -> Column:
    """'' for a blank row, OK for a sound one, PERIKSA for one to look at."""
    main, sub, second, status = (F.trim(text_or_blank(F.col(c))) for c in ("kategori_utama", "subkategori_primer", "kategori_sekunder", "annotation_status"))
    empty = (main == "") & (sub == "") & (second == "")
    labelled = (status == "LABELED") & valid_pair(main, sub) & ((second == "") | (second.isin(*TAXONOMY) & (second != main)))
    return F.when(empty & (status == ""), "").when((empty & (status == "UNCLEAR")) | labelled, "OK").otherwise("PERIKSA")


def agreement_state(one: Column, two: Column) -> Column:
    a, b = F.trim(text_or_blank(one)), F.trim(text_or_blank(two))
    return F.when((a == "") | (b == ""), "BELUM_LENGKAP").when(a == b, "SETUJU").otherwise("BEDA")


def adjudicated(df: DataFrame) -> DataFrame:
    """Agreement state, final label and status of each item of two annotators and an adjudicator."""
    a, adj = F.trim(text_or_blank(F.col("annotator_1"))), F.trim(text_or_blank(F.col("adjudicated_label")))
    state = agreement_state(F.col("annotator_1"), F.col("annotator_2"))
    unclear = F.upper(a) == "UNCLEAR"
    final = F.when((state == "SETUJU") & ~unclear, a).otherwise(adj)
    status = F.when(state == "BELUM_LENGKAP", "BELUM_LENGKAP").when((state == "SETUJU") & ~unclear, "SIAP").when((state == "SETUJU") & unclear, "UNCLEAR").when(final != "", "ADJUDICATED").otherwise("REVIEW")
    return df.select("tweet_id", state.alias("state"), final.alias("final_label"), status.alias("final_status"))


def annotation_progress(df: DataFrame) -> DataFrame:
    s = adjudicated(df)
    return s.agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("state") == "SETUJU").alias("agreed"), F.count_if(F.col("state") == "BEDA").alias("different"), F.count_if(F.col("final_status").isin("SIAP", "ADJUDICATED")).alias("final_ready"))


def category_kappa(df: DataFrame, a: str, b: str, categories: list[str] = LABELS, limit: float = 0.8) -> DataFrame:
    """Kappa over complete pairs with chance agreement from the listed categories only, and the pilot's gate."""
    pairs = df.where((text_or_blank(F.col(a)) != "") & (text_or_blank(F.col(b)) != ""))
    counts = [F.count_if(F.col(x) == c).alias(f"{x}_{i}") for x in (a, b) for i, c in enumerate(categories)]
    out = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agreed"), *counts)
    n = F.col("n").cast("double")
    cross = sum((F.col(f"{a}_{i}") * F.col(f"{b}_{i}") for i in range(1, len(categories))), F.col(f"{a}_0") * F.col(f"{b}_0")).cast("double")
    po, pe = F.try_divide(F.col("agreed").cast("double"), n), F.try_divide(cross, n * n)
    k = F.try_divide(po - pe, 1 - pe)
    return out.select("n", "agreed", k.alias("kappa"), F.when(k.isNull(), "BELUM ADA DATA").when(k >= limit, "LULUS").otherwise("REVISI PANDUAN").alias("gate"))
