"""Pilot sampling by strata with a cap per thread, and splits by thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benang.functions.text import text_or_blank
from benang.session import Scratch

# fixed values: candidate keywords per category and the order of strata
RULES = {
    "Mutu_Gizi": ["porsi", "gizi", "nutrisi", "protein", "kalori", "karbohidrat", "sayur", "buah", "lauk", "menu", "rasa", "hambar", "asin", "manis", "enak", "kenyang", "basi", "busuk", "berjamur", "keracunan", "mual", "diare", "higienis", "higiene", "sanitasi", "kontaminasi", "kedaluwarsa"],
    "Tata_Kelola": ["vendor", "dapur", "mitra", "sppg", "sertifikasi", "anggaran", "dana", "biaya", "korupsi", "audit", "transparan", "akuntabel", "pengaduan", "aduan", "tindak lanjut", "bgn", "sop", "inspeksi", "verifikasi"],
    "Distribusi": ["terlambat", "kirim", "logistik", "distribusi", "jangkauan", "3t", "pelosok", "perbatasan", "kemasan", "bocor", "tumpah", "pembagian", "paket", "wadah"],
}
STRATA = ["Distribusi_Signal", "Tata_Kelola_Signal", "Mutu_Gizi_Signal", "Overlap", "No_Signal"]
REST = "~rest~"
# the same of the sampler with escalating caps
WIDE_RULES = {
    "Mutu_Gizi": ["porsi", "gizi", "nutrisi", "protein", "kalori", "karbohidrat", "karbo", "sayur", "buah", "lauk", "menu", "rasa", "hambar", "asin", "manis", "enak", "kenyang", "basi", "busuk", "berjamur", "keracunan", "mual", "diare", "higienis", "higiene", "sanitasi", "kontaminasi", "kedaluwarsa", "kadaluarsa"],
    "Tata_Kelola": ["vendor", "mitra", "dapur", "sppg", "bgn", "anggaran", "dana", "biaya", "korupsi", "mark[ -]?up", "audit", "transparansi", "akuntabilitas", "sop", "sertifikat", "sertifikasi", "inspeksi", "pengaduan", "aduan", "dilaporkan", "laporan", "tindak lanjut", "ditindaklanjuti", "evaluasi"],
    "Distribusi": ["distribusi", "logistik", "kurir", "pengiriman", "dikirim", "terlambat", "telat", "jadwal", "rantai pasok", "dibagi", "pembagian", "dibagikan", "paket", "kemasan", "kotak", "bocor", "tumpah", "jangkauan", "terjangkau", "pelosok", "perbatasan", "tertinggal", "terluar", "3t", "kebagian"],
}
WIDE_STRATA = ["Distribusi_Signal", "Overlap", "Mutu_Gizi_Signal", "Tata_Kelola_Signal", "No_Signal"]


def pattern(words: list[str]) -> str:
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


def matched(text: Column, rules: dict[str, list[str]] = RULES) -> Column:
    t = text_or_blank(text)
    return F.array_compact(F.array(*[F.when(t.rlike(pattern(w)), k) for k, w in rules.items()]))


def stratum(text: Column, rules: dict[str, list[str]] = RULES) -> tuple[Column, Column]:
    """The stratum of a text and the categories whose words it has."""
    m = matched(text, rules)
    return F.when(F.size(m) == 0, "No_Signal").when(F.size(m) == 1, F.concat(m[0], F.lit("_Signal"))).otherwise("Overlap"), F.array_join(m, ",")


def with_stratum(df: DataFrame, text: str = "teks_komentar", rules: dict[str, list[str]] = RULES) -> DataFrame:
    s, why = stratum(F.col(text), rules)
    return df.withColumns({"stratum": s, "reason": why})


def rank_hash(seed: str, stage: str, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(stage), *[F.col(p) for p in parts]))


def sample(df: DataFrame, total: int, cap: int, seed: str = "20260907", strata: list[str] = STRATA) -> DataFrame:
    """``total`` rows: each stratum in order gives total / strata rows, one per thread and round, never more than
    ``cap`` per thread over all strata; what lacks is filled up thread by thread. Takes (tweet_id, root, stratum)
    with distinct ids; a stage is one window and one limit, and only the running sample (at most ``total`` rows)
    is carried on."""
    if total <= 0 or cap <= 0:
        raise ValueError("total and cap must be positive")
    scratch = Scratch(df.sparkSession)
    pool = scratch.save(df.select("tweet_id", "root_tweet_id", "stratum"))
    chosen, taken = None, 0
    quota = max(total // len(strata), 1)
    for stage in [*strata, REST]:
        want = min(quota, total - taken) if stage != REST else total - taken
        if want <= 0:
            continue
        rows = pool if stage == REST else pool.where(F.col("stratum") == stage)
        if chosen is not None:
            used = chosen.groupBy("root_tweet_id").agg(F.count(F.lit(1)).alias("used"))
            rows = rows.join(chosen.select("tweet_id"), "tweet_id", "left_anti").join(used, "root_tweet_id", "left")
        else:
            rows = rows.withColumn("used", F.lit(0))
        k = F.row_number().over(W.partitionBy("root_tweet_id").orderBy(rank_hash(seed, stage, "tweet_id"), "tweet_id"))
        # the constant limit lets Spark cut each thread before it is shuffled
        ranked = rows.withColumn("k", k).where(F.col("k") <= cap).where(F.col("k") <= cap - F.coalesce("used", F.lit(0)))
        h = rank_hash(seed, stage, "root_tweet_id")
        order = [h, F.col("root_tweet_id"), F.col("k")] if stage == REST else [F.col("k"), h, F.col("root_tweet_id")]
        got = ranked.orderBy(*order).limit(want).select("tweet_id", "root_tweet_id", "stratum", F.lit(stage).alias("stage"))
        chosen = scratch.save(got if chosen is None else chosen.unionByName(got))
        taken = chosen.count()
    return chosen


def checked_ids(df: DataFrame) -> DataFrame:
    """Raises where ids are blank or come twice."""
    bad = df.agg(F.count_if(F.trim(text_or_blank(F.col("tweet_id"))) == "").alias("blank"), (F.count(F.lit(1)) - F.count_distinct("tweet_id")).alias("twice")).first()
    if bad["blank"] or bad["twice"]:
        raise ValueError("blank or duplicate ids")
    return df


def hash_positions(df: DataFrame, by: list[str], h: Column, tie: str, name: str = "position") -> DataFrame:
    """Row numbers from 1 within groups in the order of a hexadecimal hash. Ranks are taken in 4,096 ranges of the hash
    and added up, so that a hot group, or all rows, are not ordered in one task."""
    inner = df.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 3))
    inside = inner.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_range").orderBy("_h", tie)))
    per = inner.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    order = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    before = per.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_range2"), (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    on = inside["_range"] == before["_range2"]
    for i, c in enumerate(by):
        on = on & inside[c].eqNullSafe(before[f"_by{i}"])
    return inside.join(before, on).withColumn(name, (F.col("_before") + F.col("_r")).cast("int")).select(*df.columns, name)


def group_split(df: DataFrame, group: str, sizes: dict[str, float], seed: str = "42") -> DataFrame:
    """Groups given to parts by hash rank; sizes are shares of the number of groups."""
    g = df.select(group).distinct()
    placed = hash_positions(g, [], F.md5(F.concat_ws("|", F.lit(seed), F.col(group))), group)
    n = g.count()
    low, total, cuts = 0.0, sum(sizes.values()), []
    for name, s in sizes.items():
        low += s / total
        cuts.append((name, low))
    at = (F.col("position") - 1) / F.lit(float(max(1, n)))
    part = F.lit(cuts[-1][0])
    for name, high in reversed(cuts[:-1]):
        part = F.when(at < F.lit(round(high, 9)), name).otherwise(part)
    return placed.select(group, part.alias("part"))


def folds(df: DataFrame, group: str, n: int, seed: str = "42") -> DataFrame:
    return df.select(group).distinct().withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(group))), 1, 8), 16, 10).cast("long"), F.lit(n)))


def leakage(parts: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one part."""
    return parts.groupBy(group).agg(F.count_distinct("part").alias("n_parts")).where("n_parts > 1")


def root_coverage(chosen: DataFrame) -> DataFrame:
    n = chosen.groupBy("root_tweet_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_roots"), F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"))


LABEL_COLUMNS = ["kategori_utama", "subkategori_primer", "kategori_sekunder", "annotation_status", "annotator_1", "annotator_2", "adjudicated_label"]


def blind(chosen: DataFrame, version: str) -> DataFrame:
    """What annotators get: ids and texts, labels blank, no stratum, the version of the guide."""
    return chosen.select("tweet_id", "root_tweet_id", "teks_root", "teks_komentar", *[F.lit("").alias(c) for c in LABEL_COLUMNS], F.lit(version).alias("label_guide_version"))


def escalating_sample(df: DataFrame, quota: int, caps: tuple[int, ...], seed: str = "20260907", strata: list[str] = STRATA, partial: bool = False) -> DataFrame:
    """``quota`` rows of every stratum; where a cap per thread leaves a stratum short, the next cap is tried. Where
    even the last does not do: raises, or with ``partial`` gives what the last cap gives, short strata as they are."""
    scratch = Scratch(df.sparkSession)
    df = scratch.save(df.select("tweet_id", "root_tweet_id", "stratum"))
    for cap in caps:
        chosen = scratch.save(sample(df, quota * len(strata), cap, seed, strata).where(F.col("stage") != REST))
        full = chosen.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == quota).count()
        if full == len(strata):
            return chosen.withColumn("cap", F.lit(cap))
    if partial:
        return chosen.withColumn("cap", F.lit(caps[-1]))
    raise ValueError("a stratum is too small for its quota")


def prepare(df: DataFrame, total: int, cap: int, version: str, seed: str = "20260907", rules: dict[str, list[str]] = RULES, partial: bool = False) -> DataFrame:
    """The blind pilot: replies with a filled context, strata, the sample, shuffled again; exactly ``total`` rows or
    an error, with ``partial`` all the cap allows where these are fewer."""
    from benang.operators.relations import direct_replies, roots_of, with_context

    frame = with_context(direct_replies(df), roots_of(df)).where((F.trim(text_or_blank(F.col("teks_root"))) != "") & (F.trim(text_or_blank(F.col("teks_komentar"))) != ""))
    frame = Scratch(df.sparkSession).save(with_stratum(frame, rules=rules))
    checked_ids(frame)
    chosen = sample(frame, total, cap, seed, [*[f"{c}_Signal" for c in reversed(rules)], "Overlap", "No_Signal"])
    if not partial and chosen.count() != total:
        raise ValueError("the data do not give so many rows")
    rows = frame.join(chosen.select("tweet_id"), "tweet_id", "left_semi")
    return blind(rows, version).orderBy(rank_hash(seed, "order", "tweet_id"))


def label_map(df: DataFrame, column: str) -> DataFrame:
    """Labels numbered in their order."""
    labels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    return labels.withColumn("index", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("label")) - 1)  # one row per label


def presets(groups: dict[str, list[str]], spark) -> DataFrame:
    """Keywords of all groups in order, first spelling kept: (position, keyword, preset)."""
    from benang.operators.summary import ordered_distinct

    rows = [(i, w, g) for i, (g, w) in enumerate((g, w) for g, ws in groups.items() for w in ws)]
    return ordered_distinct(spark.createDataFrame(rows, "position int, keyword string, preset string"), "keyword", ["position"])
