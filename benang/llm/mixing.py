"""Mixing sources to target weights: temperature mixing with a repetition limit.

The token share of a source is raised to an exponent (the inverse of its temperature: 1 as it is, below 1 flatter, above
1 sharper). Bisection finds the least exponent at which the weight neither exceeds the share the target asks for, so that
the source carries its part of the target entropy, nor the share its tokens reach in ``max_repeats`` passes. What the
bisected weights are is what is realised: they are multiplied by the token budget and cut out of whole passes over
permuted blocks of documents, with a partial pass last; normalised, they are the shares of the mix. A source whose
realised weight stays below its target falls short.

Defined results: a null or empty text has 0 tokens; a null source is the source ''; a target source without
documents has 0 tokens and falls short when its share is above 0; null shares count as 0, a null max_repeats as 1;
empty tables give empty results. Whole texts are counted.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from benang.session import Scratch, broadcast_if_small

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the split pattern published with the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


#: a run without white space this long would make the byte-pair merge quadratic; it alone is cut
LONG_WORD = re.compile(r"\S{2000,}")


def count_tokens(text: str, path: str) -> int:
    """Tokens of the whole text; endless unbroken runs are encoded in pieces of 2000 characters, the rest as it is."""
    enc = encoder(path)
    n = at = 0
    for m in LONG_WORD.finditer(text):
        n += len(enc.encode_ordinary(text[at:m.start()]))
        n += sum(len(enc.encode_ordinary(text[i:min(i + 2000, m.end())])) for i in range(m.start(), m.end(), 2000))
        at = m.end()
    return n + len(enc.encode_ordinary(text[at:]))


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [count_tokens(t, path) if isinstance(t, str) and t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").mapInPandas(run, "doc_id long, source string, n_tokens long")


def source_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    return token_counts(docs, path).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def exponent_for(share: float, target: float, limit: float, rounds: int = 200) -> float:
    """The least exponent that brings ``share`` (below 1) to ``target`` or ``limit``, whichever is reached last;
    infinite where nothing may be taken."""
    if share <= 0 or target <= 0 or limit <= 0:
        return math.inf
    fits = lambda e: share**e <= target and share**e <= limit
    low, high = 0.0, 1.0
    while not fits(high):
        low, high = high, 2 * high
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def tempered(share: float, exponent: float) -> float:
    return share**exponent if share > 0 and exponent < math.inf else 0.0


def mix_plan(pdf: pd.DataFrame, temper=exponent_for) -> pd.DataFrame:
    """Exponents, weights, passes and shares of one mix (one row per source). ``temper`` finds an exponent."""
    pdf = pdf.sort_values("source", kind="stable").reset_index(drop=True)
    budget = float(pdf["all_tokens"].iloc[0]) if len(pdf) else 0.0
    tokens, target, repeats = ([float(x) for x in pdf[c]] for c in ("tokens", "target_share", "max_repeats"))
    # one token more in all keeps the share of a lone source below 1
    shares = [t / (budget + 1) for t in tokens]
    limit = [r * t / budget if budget else 0.0 for r, t in zip(repeats, tokens)]
    exponents = [temper(s, t, c) for s, t, c in zip(shares, target, limit)]
    weights = [tempered(s, e) for s, e in zip(shares, exponents)]
    total = sum(weights)
    out = pdf[["mix_name", "source", "target_share", "max_repeats", "tokens"]].copy()
    out["exponent"] = [e if e < math.inf else None for e in exponents]
    out["weight"] = [w / total if total > 0 else 0.0 for w in weights]
    out["budget_tokens"] = [int(min(round(w * budget), r * t)) for w, r, t in zip(weights, repeats, tokens)]
    out["passes"] = [w * budget / t if t > 0 else 0.0 for w, t in zip(weights, tokens)]
    # short where the realised weight is below the target; within rounding the exact products decide
    out["short"] = [t > 0 and budget > 0 and (w < t * (1 - 1e-9) or abs(w - t) <= 1e-9 * t and r * n < t * budget) for w, t, r, n in zip(weights, target, repeats, tokens)]
    return out


PLAN = "mix_name string, source string, target_share double, max_repeats int, tokens long, exponent double, weight double, budget_tokens long, passes double, short boolean"


def plan(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, sizes: DataFrame | None = None) -> DataFrame:
    """Per mix and source: exponent, normalised weight, token budget, passes, and whether the source falls short."""
    sizes = Scratch(docs.sparkSession).save(sizes if sizes is not None else source_tokens(docs, path))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    t = targets.select("mix_name", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats")).dropDuplicates(["mix_name", "source"])
    rows = t.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("all_tokens", F.lit(int(total)))
    return rows.groupBy("mix_name").applyInPandas(lambda p: mix_plan(p), PLAN)


def found(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    return plan(docs, targets, path).where("short").select("mix_name", "source")


def prepared(docs: DataFrame, targets: DataFrame, path: str, block_rows: int = 100_000) -> tuple[DataFrame, DataFrame, int]:
    """Token counts, plans, and the number of hash digits that gives blocks of about ``block_rows`` documents."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(token_counts(docs, path))
    sizes = scratch.save(counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    return counts, scratch.save(plan(docs, targets, path, sizes=sizes.select("source", "tokens"))), 1 + math.ceil(math.log(max(1.0, most / block_rows), 16))


def realise(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: str = "benang") -> DataFrame:
    """The mix itself: one row per mix, document and pass. Documents of a source are permuted by hash; running token
    sums are taken per block of the permutation and added up over blocks, so no source is ordered in one task."""
    counts, plans, digits = prepared(docs, targets, path)
    return placed(counts, plans, targets, seed, digits)


def placed(counts: DataFrame, plans: DataFrame, targets: DataFrame, seed: str, digits: int) -> DataFrame:
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    blocks = counts.where("n_tokens > 0").withColumn("h", h).withColumn("block", F.substring("h", 1, digits))
    inside = blocks.withColumn("in_block", F.sum("n_tokens").over(W.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)))
    sums = blocks.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    at = inside.join(before, ["source", "block"]).withColumn("start", F.col("before") + F.col("in_block") - F.col("n_tokens"))
    mixed = at.join(broadcast_if_small(plans.where("budget_tokens > 0").select("mix_name", "source", "tokens", "budget_tokens"), targets), "source")
    # a pass takes a document while the tokens of earlier passes and documents stay below the budget
    passes = F.ceil((F.col("budget_tokens") - F.col("start")) / F.col("tokens"))
    return mixed.where("start < budget_tokens").select("mix_name", "source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), passes.cast("int"))).alias("pass"))


def shares(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: str = "benang") -> DataFrame:
    """The plan with what the mix as realised holds: tokens, rows and share per mix and source."""
    counts, plans, digits = prepared(docs, targets, path)
    made = placed(counts, plans, targets, seed, digits).groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_rows"))
    out = plans.join(made, ["mix_name", "source"], "left").na.fill(0, ["mixed_tokens", "mixed_rows"])
    whole = F.sum("mixed_tokens").over(W.partitionBy("mix_name"))  # a few rows: the sources of a mix
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), whole), F.lit(0.0)))
