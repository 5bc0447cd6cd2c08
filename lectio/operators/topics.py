"""Trained topics: weighted terms and multinomial naive Bayes, as a pipeline of Spark's own estimators."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an untrained topic is given.
UNTRAINED = 0.9


def fit(docs: DataFrame, labels: DataFrame, terms: int = 1 << 17) -> PipelineModel | None:
    """A model of (doc_id, text) and (doc_id, label 0 or 1); None where only one label occurs. Null texts and labels take no part."""
    train = docs.select("doc_id", "text").where("text IS NOT NULL").join(labels.select("doc_id", F.col("label").cast("double")).where("label IS NOT NULL"), "doc_id")
    if train.select("label").distinct().count() < 2:
        return None
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2), StopWordsRemover(inputCol="words", outputCol="content"), HashingTF(inputCol="content", outputCol="counts", numFeatures=terms), IDF(inputCol="counts", outputCol="weighted", minDocFreq=2), Normalizer(inputCol="weighted", outputCol="features", p=2.0), NaiveBayes(smoothing=0.01, modelType="multinomial", featuresCol="features", labelCol="label")]
    return Pipeline(stages=stages).fit(train)


class Store:
    """Models by category, each in a folder of its own; what was never stored, or stored as none, isn't trained."""

    def __init__(self, folder: str) -> None:
        self.folder, self.loaded = folder, {}

    def save(self, category: str, model: PipelineModel | None) -> None:
        self.loaded[category] = model
        if model is not None:
            model.write().overwrite().save(f"{self.folder}/{category}")

    def load(self, category: str) -> PipelineModel | None:
        if category not in self.loaded:
            try:
                self.loaded[category] = PipelineModel.load(f"{self.folder}/{category}")
            except Exception as missing:  # a folder that isn't there is told apart from one that can't be read
                if "does not exist" not in str(missing):
                    raise
                self.loaded[category] = None
        return self.loaded[category]


def predict(docs: DataFrame, model: PipelineModel | None) -> DataFrame:
    """(doc_id, p): the probability of label 1; 0.9 where there is no model, null for null texts."""
    if model is None:
        return docs.select("doc_id", F.when(F.col("text").isNotNull(), F.lit(UNTRAINED)).alias("p"))
    got = model.transform(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("void")))
    return got.select("doc_id", F.when(~F.col("void"), F.round(vector_to_array("probability")[1], 6)).alias("p"))
