"""Text classifiers as pipelines: the registry of experiments and what it builds."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, NaiveBayes, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benang.operators.pilot import matched

# fixed values: the smoothing grid and the experiments
ALPHAS = (0.01, 0.03, 0.1, 0.3, 0.5, 1.0, 2.0)
REGISTRY = {
    "E0": "most frequent label, or labels drawn by their shares", "E1": "keyword rules", "E2": "bernoulli naive bayes, binary words and pairs", "E3": "multinomial naive bayes, tf-idf", "E4": "complement naive bayes, tf-idf",
    "E5": "complement naive bayes, words and characters", "E6": "complement naive bayes, reply with weighted root context", "Audit": "linear support vectors, tf-idf",
}
#: distinct terms a vocabulary may hold, the most frequent first; a greater number keeps them all
VOCABULARY = 1 << 20


class SublinearTF(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts to 1 + ln(count)."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        def log(v):
            return SparseVector(v.size, v.indices, 1 + np.log(v.values)) if isinstance(v, SparseVector) else Vectors.dense(np.where(v.values > 0, 1 + np.log(np.maximum(v.values, 1)), 0))

        return df.withColumn(self.getOutputCol(), F.udf(log, VectorUDT())(self.getInputCol()))


class SmoothIDF(Estimator, HasInputCol, HasOutputCol):
    """Counts times 1 + ln((1 + rows) / (1 + rows with the term)): a term of every row still weighs 1."""

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, df: DataFrame):
        idf = IDF(inputCol=self.getInputCol(), outputCol="_idf").fit(df).idf
        return ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def words(prefix: str, text: str, vocabulary: int = VOCABULARY) -> list:
    """Stages from a text column to counts of words and pairs of words in {prefix}_counts."""
    return [
        RegexTokenizer(inputCol=text, outputCol=f"{prefix}_w", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2), NGram(n=2, inputCol=f"{prefix}_w", outputCol=f"{prefix}_2"),
        SQLTransformer(statement=f"SELECT *, concat({prefix}_w, {prefix}_2) AS {prefix}_terms FROM __THIS__"), CountVectorizer(inputCol=f"{prefix}_terms", outputCol=f"{prefix}_counts", vocabSize=vocabulary),
    ]


def weighted(prefix: str, sublinear: bool = True) -> list:
    """Stages from counts to tf-idf of unit length, with 1 + ln(count) for counts where ``sublinear``."""
    counts = f"{prefix}_log" if sublinear else f"{prefix}_counts"
    log = [SublinearTF(inputCol=f"{prefix}_counts", outputCol=counts)] if sublinear else []
    return [*log, SmoothIDF(counts, f"{prefix}_idf"), Normalizer(inputCol=f"{prefix}_idf", outputCol=f"{prefix}_vec")]


def characters(prefix: str, text: str, vocabulary: int = VOCABULARY) -> list:
    """Counts of runs of three to five characters inside words with a blank at either end."""
    runs = f"transform(sequence(3, least(5, length(x) + 2)), n -> transform(sequence(1, length(x) + 3 - n), i -> substring(concat(' ', x, ' '), i, n)))"
    made = f"flatten(transform(filter(split(lower({text}), '\\\\s+'), x -> x <> ''), x -> flatten({runs})))"
    return [SQLTransformer(statement=f"SELECT *, {made} AS {prefix}_terms FROM __THIS__"), CountVectorizer(inputCol=f"{prefix}_terms", outputCol=f"{prefix}_counts", vocabSize=vocabulary)]


def build(name: str, text: str = "text", root: str = "root_text", label: str = "label", alpha: float = 1.0, root_weight: float = 0.3) -> Pipeline:
    """The pipeline of an experiment; E0 and E1 have none (see most_frequent, keyword_label)."""
    index = StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip", stringOrderType="alphabetAsc")
    if name == "E2":
        binary = words("t", text)
        binary[-1].setBinary(True)
        return Pipeline(stages=[index, *binary, NaiveBayes(featuresCol="t_counts", labelCol="y", modelType="bernoulli", smoothing=alpha)])
    if name in ("E3", "E4"):
        return Pipeline(stages=[index, *words("t", text), *weighted("t"), NaiveBayes(featuresCol="t_vec", labelCol="y", modelType="multinomial" if name == "E3" else "complement", smoothing=alpha)])
    if name == "E5":
        return Pipeline(stages=[index, *words("t", text), *weighted("t", False), *characters("c", text), *weighted("c", False), VectorAssembler(inputCols=["t_vec", "c_vec"], outputCol="x"), NaiveBayes(featuresCol="x", labelCol="y", modelType="complement", smoothing=alpha)])
    if name == "E6":
        scale = Scale("r_vec", "r_scaled", root_weight)
        return Pipeline(stages=[index, *words("t", text), *weighted("t"), *words("r", root), *weighted("r"), scale, VectorAssembler(inputCols=["t_vec", "r_scaled"], outputCol="x"), NaiveBayes(featuresCol="x", labelCol="y", modelType="complement", smoothing=alpha)])
    if name == "Audit":
        return Pipeline(stages=[index, *words("t", text), *weighted("t", False), OneVsRest(classifier=LinearSVC(maxIter=10), featuresCol="t_vec", labelCol="y")])
    raise ValueError(f"no pipeline for {name}")


class Scale(Estimator, HasInputCol, HasOutputCol):
    """A vector times a number; fitted only to know its length."""

    def __init__(self, inputCol: str, outputCol: str, factor: float):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.factor = factor

    def _fit(self, df: DataFrame):
        first = df.select(self.getInputCol()).first()
        size = first[0].size if first else 0
        return ElementwiseProduct(scalingVec=Vectors.dense([self.factor] * size), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def most_frequent(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(1)


def stratified(df: DataFrame, label: str = "label", key: str = "tweet_id", seed: str = "42") -> DataFrame:
    """A label for every row, drawn by hash with the shares the labels have."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(F.lit(1))  # one row per label
    shares = n.withColumn("high", F.sum("n").over(whole.orderBy("prediction").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(whole)).withColumn("low", F.lag("high", 1, 0.0).over(whole.orderBy("prediction")))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    steps = shares.agg(F.array_sort(F.collect_list(F.struct("high", "prediction"))).alias("steps"))
    return df.withColumn("u", u).join(F.broadcast(steps)).withColumn("prediction", F.element_at(F.filter("steps", lambda x: F.col("u") < x["high"]), 1)["prediction"]).drop("u", "steps")


def keyword_label(df: DataFrame, text: str = "text") -> DataFrame:
    """The category whose keywords a text has, where it is one."""
    m = matched(F.col(text))
    return df.withColumn("prediction", F.when(F.size(m) == 1, m[0]))


def ready(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Whether a frame has filled labels, and at least one valid one."""
    lab = F.trim(F.coalesce(F.col(label), F.lit("")))
    return df.agg(F.count_if(lab != "").alias("n_filled"), F.count_if(lab.isin(*labels)).alias("n_valid")).withColumn("ready", (F.col("n_filled") > 0) & (F.col("n_valid") > 0))


def predictions(model, df: DataFrame, labels: list[str], version: str, guide: str = "1.0", least: float = 0.6, least_margin: float = 0.15) -> DataFrame:
    """Class, confidence, margin to the second class, status and version of every row; of ties the later class."""
    from pyspark.ml.functions import vector_to_array

    from benang.functions.text import top_two
    from benang.operators.metrics import abstention

    out = model.transform(df).withColumn("p", vector_to_array("probability"))
    best, confidence, margin = top_two(F.col("p"))
    return out.select("tweet_id", F.element_at(F.array(*[F.lit(x) for x in labels]), best + 1).alias("prediction"), confidence.alias("confidence"), margin.alias("margin"), abstention(confidence, margin, least, least_margin).alias("status"), F.lit(version).alias("model_version"), F.lit(guide).alias("label_guide_version"))


def export_predictions(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Predictions with the time they were made at, as one CSV with a byte-order mark; ids stay text."""
    from benang.functions.text import stamp
    from benang.sources.files import write_single_csv

    write_single_csv(rows.withColumn("tweet_id", F.col("tweet_id").cast("string")).withColumn("predicted_at", stamp(F.current_timestamp())), path, overwrite)


def score_with(df: DataFrame, text: str, make_scorer, labels: list[str], least: float = 0.6) -> DataFrame:
    """Predictions of any scorer of text batches, such as a transformer: ``make_scorer()`` is called once per task and
    gives a function from a list of texts to rows of probabilities."""
    import pandas as pd

    from benang.operators.metrics import abstention

    def run(batches):
        scorer = make_scorer()
        for b in batches:
            p = [list(map(float, r)) for r in scorer(b["text"].fillna("").tolist())] if len(b) else []
            best = [max(range(len(r)), key=r.__getitem__) for r in p]
            yield pd.DataFrame({"tweet_id": b["tweet_id"], "prediction": [labels[i] for i in best], "confidence": [r[i] for r, i in zip(p, best)]})

    out = df.select("tweet_id", F.col(text).alias("text")).mapInPandas(run, "tweet_id string, prediction string, confidence double")
    return out.withColumn("status", abstention(F.col("confidence"), None, least))


def run_experiments(train: DataFrame, test: DataFrame, names: list[str], labels: list[str], alphas: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Macro-F1 on the test part of each named experiment, for every smoothing of ``alphas`` where it has one."""
    from benang.operators.metrics import confusion, overall

    rows = []
    for n in names:
        for alpha in alphas if n in ("E2", "E3", "E4", "E5", "E6") else (None,):
            if n == "E0":
                top = most_frequent(train).first()
                done = test.withColumn("said", F.lit(top[0] if top else None).cast("string"))
            elif n == "E1":
                done = keyword_label(test).withColumnRenamed("prediction", "said")
            else:
                done = build(n, **({} if alpha is None else {"alpha": alpha})).fit(train).transform(test).withColumn("said", F.element_at(F.array(*[F.lit(x) for x in sorted(labels)]), F.col("prediction").cast("int") + 1))
            rows.append((n, alpha, float(overall(confusion(done, "label", "said"), labels).first()["macro_f1"] or 0.0)))
    return train.sparkSession.createDataFrame(rows, "experiment string, alpha double, macro_f1 double")
