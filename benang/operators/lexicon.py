"""Dictionaries of slang: validation, vocabulary, candidates, elongations, ranking, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benang.functions.text import TOKEN, collapse, squeeze, text_or_blank
from benang.session import broadcast_if_small


def mapping_rows(df: DataFrame) -> DataFrame:
    """Dictionary rows trimmed and in lower case, with ``problem``: null, empty, identity or duplicate (a repeat of a
    key; the row with the greatest count, then the least replacement, is the first)."""
    from pyspark.sql import Window as W

    low = df.select(F.lower(collapse(text_or_blank(F.col("slang")))).alias("slang"), F.lower(collapse(text_or_blank(F.col("kata_baku")))).alias("kata_baku"), F.coalesce("frekuensi", F.lit(0)).alias("frekuensi"))
    problem = F.when((F.col("slang") == "") | (F.col("kata_baku") == ""), "empty").when(F.col("slang") == F.col("kata_baku"), "identity")
    rank = F.row_number().over(W.partitionBy("slang", problem.isNull()).orderBy(F.desc("frekuensi"), "kata_baku"))
    return low.withColumn("problem", F.coalesce(problem, F.when(rank > 1, "duplicate")))


def valid_mapping(df: DataFrame) -> DataFrame:
    return mapping_rows(df).where("problem is null").drop("problem")


def lookup(df: DataFrame, rows: int = 100_000) -> Column:
    """A map literal of a valid dictionary of at most ``rows`` entries."""
    pairs = [(r["slang"], r["kata_baku"]) for r in valid_mapping(df).limit(rows + 1).collect()]
    if len(pairs) > rows:
        raise ValueError(f"more than {rows} dictionary entries")
    flat = [F.lit(x) for p in sorted(pairs) for x in p]
    return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")


def upsert(df: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary with rows of ``new`` put in place of equal keys."""
    a, b = valid_mapping(df), valid_mapping(new)
    return a.join(b.select("slang"), "slang", "left_anti").unionByName(b).orderBy("slang")


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    tokens = F.explode(F.regexp_extract_all(F.lower(text_or_blank(F.col(text))), F.lit(f"({TOKEN})"), F.lit(1)))
    return df.select(tokens.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def candidates(lexicon: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keys seen in the corpus with their one target, or as a conflict of several."""
    low = lexicon.select(F.lower(collapse(text_or_blank(F.col("slang")))).alias("slang"), F.lower(collapse(text_or_blank(F.col("kata_baku")))).alias("kata_baku")).where("slang <> '' and kata_baku <> '' and slang <> kata_baku")
    seen = low.join(vocab.select(F.col("token").alias("slang"), "n"), "slang")
    per = seen.groupBy("slang").agg(F.min("kata_baku").alias("least"), F.count_distinct("kata_baku").alias("n_targets"), F.max("n").alias("frekuensi"))
    return per.select("slang", F.when(F.col("n_targets") == 1, F.col("least")).alias("kata_baku"), "n_targets", "frekuensi", (F.col("n_targets") > 1).alias("conflict"))


def elongations(vocab: DataFrame, bases: DataFrame) -> DataFrame:
    """Words with repeated letters that squeeze to exactly one base; bases are (word, target)."""
    known = bases.select(squeeze(F.col("word")).alias("key"), F.col("target")).groupBy("key").agg(F.count_distinct("target").alias("targets"), F.min("target").alias("target")).where("targets = 1")
    words = vocab.where(F.col("token").rlike("^[a-z]{4,}$") & F.col("token").rlike(r"(.)\1")).join(bases.select(F.col("word").alias("token")).distinct(), "token", "left_anti")
    met = words.withColumn("key", squeeze(F.col("token"))).join(known, "key").where(F.col("token") != F.col("target"))
    return met.select(F.col("token").alias("slang"), F.col("target").alias("kata_baku"), F.col("n").alias("frekuensi"))


def canonical(c: Column, table: dict[str, str], rounds: int = 5) -> Column:
    """Words replaced again and again until nothing changes; null where ``rounds`` do not suffice (a cycle)."""
    mapping = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    step = lambda t: F.array_join(F.transform(F.split(t, " "), lambda x: F.coalesce(F.try_element_at(mapping, x), x)), " ")
    value = F.lower(collapse(c))
    for _ in range(rounds - 1):
        value = step(value)
    return F.when(step(value) == value, value)


def rank(records: DataFrame, count: int) -> DataFrame:
    """The ``count`` most frequent records; of equals lexical before elongated ones, then by key."""
    return records.orderBy(F.desc("frekuensi"), F.col("source") == "elongation", F.col("source") != "review", "slang").limit(count)


def coverage(df: DataFrame, text: str, mapping: DataFrame) -> DataFrame:
    """Entries, token occurrences they cover, and rows with at least one of them."""
    keys = valid_mapping(mapping).select(F.col("slang").alias("token"))
    # the row number is given before tokens multiply the rows
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(F.lower(text_or_blank(F.col(text))), F.lit(f"({TOKEN})"), F.lit(1)).alias("tokens"))
    found = rows.select("row", F.explode("tokens").alias("token")).join(broadcast_if_small(keys, mapping), "token")
    return found.agg(F.count_distinct("token").alias("n_entries_seen"), F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("row").alias("n_rows"))
