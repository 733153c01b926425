"""Consensus from several annotators' labels: competence-and-spamming mixture by expectation-maximisation.

Each label is either truthful (with the annotator's competence) or drawn from the annotator's own guess
distribution. Items with the same votes count as one pattern with their number, so a round costs what the different
patterns cost. The expected counts of a round are summed by Spark over all patterns; what returns to the driver is one
row per annotator and label, at most ``max_annotators`` annotators. The consensus rests on labels alone. On request
(``words``) the words of the items give each item a prior (a multinomial model fitted to the posteriors), and the mixture
is run on with these priors: that may decide items whose few annotators are all poor, and may outvote people, so it is
a result of its own (``with_words``).

Defined results: of several marks of an annotator on an item the latest holds (at equal times the greater text),
also where it is blank or UNCLEAR and so gives no label; labels match apart from case, separators and up to two
wrong letters; the labels in pilot_raw count for a slot only where annotation_marks has none for it; an adjudicated
label is one more annotator's; an item without labels has the categories' shares; ties go to the first category; null
ids are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benang.functions.ids import filled_id
from benang.session import Scratch

CATEGORIES = ["Mutu_Gizi", "Tata_Kelola", "Distribusi"]
ADJUDICATOR = "#adjudicated"


def label_index(c: Column, categories: list[str] = CATEGORIES, slack: int = 2) -> Column:
    """Index of the category a label names, null where it names none."""
    text = F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(categories))):
        key = "".join(ch for ch in name.lower() if ch.isalpha())
        out = F.when(F.levenshtein(text, F.lit(key)) <= slack, i).otherwise(out)
    return out


def votes(pilot: DataFrame, marks: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """(item, annotator, label): the labels that hold."""
    m = marks.select(filled_id(F.col("tweet_id")).alias("item"), F.col("annotator_code").alias("annotator"), "slot", "mark", "marked_at").where("item is not null and annotator is not null")
    last = m.groupBy("item", "annotator").agg(F.max(F.struct("marked_at", "mark", "slot")).alias("m"))
    held = last.select("item", "annotator", F.col("m.slot").alias("slot"), label_index(F.col("m.mark"), categories).alias("label"))
    posts = pilot.select(filled_id(F.col("tweet_id")).alias("item"), "annotator_1", "annotator_2", "adjudicated_label").where("item is not null")
    given = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(a).alias("annotator"), label_index(F.col(c), categories).alias("label")) for s, a, c in ((1, "#slot1", "annotator_1"), (2, "#slot2", "annotator_2"), (0, ADJUDICATOR, "adjudicated_label"))]))
    spare = posts.select("item", given.alias("g")).select("item", "g.slot", "g.annotator", "g.label").where("label is not null").groupBy("item", "slot", "annotator").agg(F.min("label").alias("label"))
    filled = held.select("item", "slot").distinct()
    spare = spare.join(filled, ["item", "slot"], "left_anti")
    return held.select("item", "annotator", "label").where("label is not null").unionByName(spare.select("item", "annotator", "label"))


def items(pilot: DataFrame, vote: DataFrame) -> DataFrame:
    """One row per post of pilot_raw: its text and its votes as arrays (at most one vote per annotator)."""
    posts = pilot.select(filled_id(F.col("tweet_id")).alias("item"), F.col("teks_komentar").alias("text")).where("item is not null").groupBy("item").agg(F.max("text").alias("text"))
    held = vote.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("annotator", "label"))).alias("v"))
    return posts.join(held, "item", "left").select("item", "text", F.coalesce(F.col("v.annotator"), F.array().cast("array<string>")).alias("annotators"), F.coalesce(F.col("v.label"), F.array().cast("array<int>")).alias("labels"))


class Mixture:
    """Parameters: competence per annotator and guess distribution per annotator and label."""

    def __init__(self, names: list[str], k: int):
        self.index = pd.Index(names)
        self.k = k
        self.theta = np.full(len(names), 0.7)
        self.theta[[i for i, n in enumerate(names) if n == ADJUDICATOR]] = 0.95
        self.guess = np.full((len(names), k), 1.0 / k)
        self.share = np.full(k, 1.0 / k)

    def posterior(self, annotators, labels, prior: np.ndarray | None):
        """Posterior of each item, and the flat votes (item, annotator, label, truthful)."""
        n = len(labels)
        sizes = np.array([len(x) for x in labels], np.int64)
        item = np.repeat(np.arange(n), sizes)
        a = self.index.get_indexer(np.concatenate([np.asarray(x, object) for x in annotators])) if sizes.sum() else np.zeros(0, np.int64)
        lab = np.concatenate([np.asarray(x, np.int64) for x in labels]) if sizes.sum() else np.zeros(0, np.int64)
        spam = (1 - self.theta[a]) * self.guess[a, lab]
        true = self.theta[a]
        logp = np.log(self.share)[None, :].repeat(n, 0) if prior is None else prior.copy()
        np.add.at(logp, item, np.log(spam + 1e-12)[:, None])
        np.add.at(logp, (item, lab), np.log(spam + true + 1e-12) - np.log(spam + 1e-12))
        logp -= logp.max(1, keepdims=True) if n else 0
        p = np.exp(logp)
        p /= p.sum(1, keepdims=True) if n else 1
        truthful = p[item, lab] * true / (true + spam + 1e-12) if len(item) else np.zeros(0)
        return p, item, a, lab, truthful

    def update(self, counts: pd.DataFrame, smooth: float = 0.5) -> float:
        true = np.zeros((len(self.index), self.k))
        spam = np.zeros((len(self.index), self.k))
        classes = counts[counts["annotator"] == ""]
        rest = counts[counts["annotator"] != ""]
        at = self.index.get_indexer(rest["annotator"])
        true[at, rest["label"]] = rest["truthful"]
        spam[at, rest["label"]] = rest["spam"]
        share = np.zeros(self.k)
        share[classes["label"].to_numpy(int)] = classes["truthful"]
        self.share = (share + smooth) / (share + smooth).sum()
        before = self.theta
        t, s = true.sum(1), spam.sum(1)
        self.theta = np.clip((t + smooth) / (t + s + 2 * smooth), 0.01, 0.99)
        self.guess = (spam + smooth) / (s + self.k * smooth)[:, None]
        return float(np.abs(before - self.theta).max()) if len(before) else 0.0


COUNTS = "annotator string, label int, truthful double, spam double"


def priors_of(b: pd.DataFrame, k: int):
    return np.array(b["prior"].tolist(), float).reshape(len(b), k) if "prior" in b else None


def patterns(table: DataFrame) -> DataFrame:
    """Items of equal votes (and equal priors) as one row with their number ``n``."""
    keep = [c for c in ("annotators", "labels", "prior") if c in table.columns]
    return table.groupBy(*keep).agg(F.count(F.lit(1)).cast("double").alias("n"))


def expectation(table: DataFrame, model: Mixture) -> pd.DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        true, spam = np.zeros((len(model.index), model.k)), np.zeros((len(model.index), model.k))
        share = np.zeros(model.k)
        for b in batches:
            n = b["n"].to_numpy(float)
            p, item, a, lab, truthful = model.posterior(b["annotators"], b["labels"], priors_of(b, model.k))
            np.add.at(true, (a, lab), truthful * n[item])
            np.add.at(spam, (a, lab), (1 - truthful) * n[item])
            share += (p * n[:, None]).sum(0)
        rows = [("", c, share[c], 0.0) for c in range(model.k)]
        rows += [(name, c, true[i, c], spam[i, c]) for i, name in enumerate(model.index) for c in range(model.k) if true[i, c] + spam[i, c] > 0]
        yield pd.DataFrame(rows, columns=["annotator", "label", "truthful", "spam"])

    return table.mapInPandas(run, COUNTS).groupBy("annotator", "label").agg(F.sum("truthful").alias("truthful"), F.sum("spam").alias("spam")).toPandas()


def posteriors(table: DataFrame, model: Mixture) -> DataFrame:
    keep = ["item", "text", "annotators", "labels"] + (["prior"] if "prior" in table.columns else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = model.posterior(b["annotators"], b["labels"], priors_of(b, model.k))[0]
            yield pd.DataFrame({"item": b["item"], "text": b["text"], "annotators": b["annotators"], "labels": b["labels"], "p": list(p)})

    return table.select(*keep).mapInPandas(run, "item string, text string, annotators array<string>, labels array<int>, p array<double>")


def words(table: DataFrame) -> DataFrame:
    return table.select("item", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))).alias("word")).where(F.length("word") > 2)


def with_priors(post: DataFrame, k: int, scratch: Scratch, weight: float = 1.0, smooth: float = 1.0) -> DataFrame:
    """Items with log priors from their words: log odds of each word between categories, fitted to the posteriors
    of all items; an item's own posterior is taken out of the counts of its words."""
    w = words(post).join(post.select("item", "p"), "item")
    w = scratch.save(w)
    per = w.groupBy("word").agg(*[F.sum(F.col("p")[c]).alias(f"s{c}") for c in range(k)])
    size = post.agg(*[F.sum(F.col("p")[c]).alias(f"n{c}") for c in range(k)]).first()
    scored = w.join(per, "word").groupBy("item").agg(*[
        F.sum(F.log((F.col(f"s{c}") - F.col("p")[c] + smooth) / (F.lit(float(size[c] or 0.0)) + 2 * smooth))).alias(f"l{c}") for c in range(k)
    ])
    total = sum(float(x or 0.0) for x in size) or 1.0
    base = [float(np.log((float(x or 0.0) + 1) / (total + k))) for x in size]
    logs = [F.coalesce(F.col(f"l{c}"), F.lit(0.0)) for c in range(k)]
    most = F.greatest(*logs)
    prior = F.array(*[F.lit(base[c]) + F.greatest(logs[c] - most, F.lit(-30.0)) * weight for c in range(k)])
    return post.join(scored, "item", "left").select("item", "text", "annotators", "labels", prior.alias("prior"))


def fit(table: DataFrame, k: int, rounds: int = 25, tolerance: float = 1e-3, max_annotators: int = 100_000, model: Mixture | None = None) -> Mixture:
    """The mixture fitted to items; a given model goes on from where it stands."""
    scratch = Scratch(table.sparkSession)
    votes_ = scratch.save(patterns(table))
    if model is None:
        model = start(votes_, k, max_annotators)
    for _ in range(rounds):
        if model.update(expectation(votes_, model)) < tolerance:
            break
    scratch.drop(votes_)
    return model


def start(table: DataFrame, k: int, max_annotators: int) -> Mixture:
    names = [r[0] for r in table.select(F.explode("annotators").alias("a")).distinct().limit(max_annotators + 1).collect()]
    if len(names) > max_annotators:
        raise ValueError(f"more than {max_annotators} annotators")
    return Mixture(sorted(names), k)


def solve(pilot: DataFrame, marks: DataFrame, categories: list[str] = CATEGORIES, words: bool = False) -> tuple[DataFrame, Mixture]:
    """Items with final posteriors ``p``, and the fitted mixture."""
    k = len(categories)
    scratch = Scratch(pilot.sparkSession)
    table = scratch.save(items(pilot, votes(pilot, marks, categories)))
    model = fit(table, k)
    for _ in range(2 if words else 0):
        informed = scratch.save(with_priors(scratch.save(posteriors(table, model)), k, scratch))
        model = fit(informed, k, model=model)
        table = informed
    return scratch.save(posteriors(table, model)), model


def consensus(pilot: DataFrame, marks: DataFrame, categories: list[str] = CATEGORIES, words: bool = False) -> DataFrame:
    """tweet_id, category, confidence, n_labels, agreement (share of labels equal to the consensus, null if none)."""
    post, _ = solve(pilot, marks, categories, words)
    best = F.array_max("p")
    at = F.array_position("p", best).cast("int")
    n = F.size("labels")
    same = F.size(F.filter("labels", lambda x: x == at - 1))
    return post.select(F.col("item").alias("tweet_id"), F.array(*[F.lit(c) for c in categories])[at - 1].alias("category"), best.alias("confidence"), n.alias("n_labels"), F.when(n > 0, same / n).alias("agreement"))


def found(pilot: DataFrame, marks: DataFrame) -> DataFrame:
    return consensus(pilot, marks).select("tweet_id", "category")


def with_words(pilot: DataFrame, marks: DataFrame) -> DataFrame:
    """The consensus from labels beside that with the prior of words: tweet_id, category, confidence, category_words,
    confidence_words, agreement, agreement_words."""
    plain = consensus(pilot, marks)
    informed = consensus(pilot, marks, words=True).select("tweet_id", *[F.col(c).alias(f"{c}_words") for c in ("category", "confidence", "agreement")])
    return plain.join(informed, "tweet_id").select("tweet_id", "category", "confidence", "category_words", "confidence_words", "agreement", "agreement_words")


def reliability(pilot: DataFrame, marks: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """Per annotator: competence, labels given, agreement with the consensus, and the guess distribution."""
    post, model = solve(pilot, marks, categories)
    at = F.array_position("p", F.array_max("p")).cast("int") - 1
    v = post.select(at.alias("c"), F.explode(F.arrays_zip("annotators", "labels")).alias("v"))
    stats = v.groupBy(F.col("v.annotators").alias("annotator")).agg(F.count(F.lit(1)).alias("n_labels"), F.avg((F.col("v.labels") == F.col("c")).cast("int")).alias("agreement"))
    rows = [(n, float(model.theta[i]), [float(x) for x in model.guess[i]]) for i, n in enumerate(model.index)]
    fitted = pilot.sparkSession.createDataFrame(rows, "annotator string, competence double, guess array<double>")
    return stats.join(fitted, "annotator")
