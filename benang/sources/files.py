"""CSV, JSON, text and dictionary files: readers that keep ids and literal texts, writers that never overwrite."""

from __future__ import annotations

import json
import os
import tempfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from benang.functions.ids import normalize_id, trimmed
from benang.functions.text import text_or_blank
from benang.operators.relations import FIELDS, ROOT

CHECKPOINT_VERSION = 2
STATE = StructType([
    StructField("version", IntegerType()), StructField("seen_ids", ArrayType(StringType())), StructField("done_queries", ArrayType(StringType())), StructField("step2_queue", MapType(StringType(), StringType())),
    StructField("root_status", MapType(StringType(), StringType())), StructField("output_file", StringType()), StructField("saved_at", StringType()),
])
REQUIRED = ("tweet_id", "teks_komentar", "sumber_akuisisi", "hierarki_komentar")


class ContractError(RuntimeError):
    """A file does not keep the contract."""


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"').columns


def check_header(spark: SparkSession, path: str, fields: list[str] = FIELDS) -> None:
    """Raises unless the header has exactly these fields in order, apart from case."""
    if [c.lower() for c in header(spark, path)] != fields:
        raise ContractError("the header differs from the contract")


def read_csv(spark: SparkSession, path: str, fields: list[str], sep: str = ",", strict: bool = False) -> DataFrame:
    """All columns as text: literal NA stays text, quoted line breaks and quotes stay, quoted empties are ''."""
    schema = StructType([StructField(c, StringType()) for c in fields] + ([] if strict else [StructField("_broken", StringType())]))
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\u0001").option("emptyValue", "").option("enforceSchema", True)
    return reader.option("mode", "FAILFAST").csv(path) if strict else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").csv(path)


def durable(spark: SparkSession, path: str, least_replies: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a canonical CSV: distinct valid ids, count of invalid rows, and the reply queue of its roots."""
    check_header(spark, path)
    rows = read_csv(spark, path, FIELDS)
    ok = F.col("_broken").isNull()
    for c in REQUIRED:
        ok = ok & (F.trim(text_or_blank(F.col(c))) != "")
    valid = rows.where(ok).withColumn("tweet_id", normalize_id(F.col("tweet_id")))
    if not valid.where(~F.col("tweet_id").rlike("^[0-9]+$")).isEmpty():
        raise ContractError("an id is not made of digits")
    queue = valid.where((F.col("hierarki_komentar") == ROOT) & (F.coalesce(F.col("jumlah_reply").try_cast("bigint"), F.lit(0)) >= least_replies)).select("tweet_id", "keyword_matched")
    return valid.select("tweet_id").distinct(), rows.agg(F.count_if(~ok).alias("invalid")), queue


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ["slang", "kata_baku", "frekuensi"]).select("slang", "kata_baku", F.col("frekuensi").try_cast("bigint").alias("frekuensi"))


def write_mapping(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """The dictionary, validated before anything is written."""
    from benang.operators.lexicon import mapping_rows

    rows = mapping_rows(df.where((F.trim(text_or_blank(F.col("slang"))) != "") | (F.trim(text_or_blank(F.col("kata_baku"))) != "")))
    if not rows.where("problem is not null").isEmpty():
        raise ContractError("empty, identical or duplicate entries")
    write_csv(rows.drop("problem").orderBy("slang"), path, overwrite)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Every value quoted and untrimmed; a folder of part files, refused where the path exists."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_single_csv(df: DataFrame, path: str, overwrite: bool = False, bom: bool = True) -> None:
    """One local file with a byte-order mark for hand-over to people; written aside, then renamed."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    folder = tempfile.mkdtemp(prefix="benang-csv-", dir=os.path.dirname(path) or ".")
    try:
        write_csv(df.coalesce(1), f"{folder}/out")
        part = next(f for f in os.listdir(f"{folder}/out") if f.startswith("part-"))
        with open(f"{folder}/out/{part}", "rb") as src, open(f"{folder}/whole", "wb") as dst:
            if bom:
                dst.write(b"\xef\xbb\xbf")
            for piece in iter(lambda: src.read(1 << 20), b""):
                dst.write(piece)
            dst.flush()
            os.fsync(dst.fileno())
        os.replace(f"{folder}/whole", path)
    finally:
        import shutil

        shutil.rmtree(folder, ignore_errors=True)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A checkpoint: version checked, ids normalised, blank keys dropped."""
    df = spark.read.schema(STATE).option("multiLine", True).json(path)
    if df.where(F.coalesce("version", F.lit(0)) != CHECKPOINT_VERSION).limit(1).count() or df.isEmpty():
        raise ContractError("unknown checkpoint version")
    full = lambda c: F.map_filter(F.coalesce(c, F.create_map().cast("map<string,string>")), lambda k, _: F.trim(k) != "")
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("seen_ids", F.array().cast("array<string>")), normalize_id), lambda x: x != "")))
    return df.withColumns({"seen_ids": ids, "step2_queue": full(F.col("step2_queue")), "root_status": full(F.col("root_status"))})


def read_state_or_error(spark: SparkSession, path: str) -> tuple[DataFrame | None, str]:
    try:
        return read_state(spark, path), ""
    except Exception as e:
        return None, str(e).splitlines()[0]


def state_summary(state: DataFrame) -> DataFrame:
    return state.select(F.size("seen_ids").alias("n_seen"), F.size("done_queries").alias("n_queries"), F.size("step2_queue").alias("n_queue"), F.slice(F.array_sort(F.map_keys("step2_queue")), 1, 5).alias("first_keys"))


def write_state(payload: dict, path: str) -> None:
    """Sorted JSON, written aside, synced and renamed; an old file survives a failure."""
    aside = f"{path}.tmp"
    with open(aside, "w", encoding="utf-8") as f:
        json.dump(payload | {"version": CHECKPOINT_VERSION}, f, ensure_ascii=False, sort_keys=True, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank; a leading # is text."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("value")).where("value <> ''")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("errorifexists").text(path)


def uncommented(line: str) -> str:
    """A line up to a # that follows a blank and stands in no quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def read_rules(path: str) -> dict[str, list[str]]:
    """Category -> keywords from YAML-like text: either ``keywords:`` lists or flat lists; a missing file is {}.

    Keys that begin with # or _ are left out."""
    if not os.path.exists(path):
        return {}
    rules: dict[str, list[str]] = {}
    current = None
    with open(path, encoding="utf-8") as f:
        for line in f:
            bare = uncommented(line).rstrip()
            if not bare.strip():
                continue
            if not bare[0].isspace() and bare.endswith(":"):
                current = None if bare[0] in "#_" else bare[:-1].strip().strip("'\"")
                if current:
                    rules[current] = []
            elif bare.strip().startswith("- ") and current:
                rules[current].append(bare.strip()[2:].strip().strip("'\""))
    return rules


def latest_file(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def write_report(rows: DataFrame, path: str, most: int = 1000) -> None:
    """A small result as pretty JSON; refused where it has more than ``most`` rows."""
    data = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(data) > most:
        raise ValueError(f"a report of more than {most} rows")
    with open(urlparse(path).path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2, default=str)


def read_lexicons(spark: SparkSession, tsv: str, csv: str, tsv_fields: list[str], csv_fields: list[str]) -> DataFrame:
    """Two dictionaries of different form as one of (slang, kata_baku, source); the first two fields count."""
    a, b = read_csv(spark, tsv, tsv_fields, sep="\t"), read_csv(spark, csv, csv_fields)
    pick = lambda df, fields, name: df.select(F.col(fields[0]).alias("slang"), F.col(fields[1]).alias("kata_baku"), F.lit(name).alias("source"))
    return pick(a, tsv_fields, "tsv").unionByName(pick(b, csv_fields, "csv"))


def export_pilot(blind: DataFrame, coordinator: DataFrame, audit: DataFrame, folder: str) -> None:
    """The blind rows, the strata apart from them, and the audit; nothing is overwritten."""
    os.makedirs(folder, exist_ok=True)
    write_single_csv(blind, f"{folder}/pilot.csv")
    write_single_csv(coordinator, f"{folder}/coordinator_sampling.csv")
    write_report(audit, f"{folder}/audit.json")
