"""A quality classifier by compression: a text is good if a dictionary of good texts compresses it better than one of bad texts.

Two zstandard dictionaries are built from labelled texts. Each text is compressed in chunks under either, and the difference
of the two sizes over their sum is its margin. A logistic curve fitted on labelled texts that the dictionaries haven't seen
turns the margin into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectio.llm.blocks import arrow_map, slices, view

#: Labelled documents of each class that the model is fitted on, at most, and bytes of their texts that are used.
SAMPLE, SAMPLE_BYTES = 1500, 12 << 20
DICTIONARY_BYTES, LEVEL = 112_640, 3
#: Texts are compressed in chunks, so that long ones are measured by the dictionary all along and not by their own beginning.
CHUNK = 1024
#: The part of good texts that the decision to keep is set to leave alone, by held-out labelled texts.
KEEP_GOOD = 0.995


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    threshold: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return tuple(_compressor(d) for d in (self.good, self.bad))


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of these texts: trained where there are enough of them, and else (a few texts, or hardly any that differ) the texts themselves, whole."""
    parts = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)


def margin(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(bad - good) / (bad + good) for the compressed sizes; over 0 where the good dictionary does better."""
    a = b = 0
    for i in range(0, len(text), CHUNK):
        part = text[i : i + CHUNK]
        a += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - a) / (a + b)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a calibrated curve, both classes weighing the same, by Newton's method."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, keep_good: float = KEEP_GOOD) -> Model | None:
    """A model of the labelled documents; None where a class has fewer than two texts.

    Good is quality 1 and not toxic, bad is quality 0. Of each class the `sample` documents whose ids hash lowest are used,
    half for the dictionary and half for the curve, as whole texts and until sample_bytes are reached. Null labels, ids and texts, empty
    texts and ids with labels of both classes take no part; of rows that repeat an id, the least text does. Further columns
    are ignored, whatever they are called; an empty table of either kind gives None.
    """
    judged = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality") == 0, 0).alias("good")).where("labelled IS NOT NULL AND good IS NOT NULL")
    judged = judged.groupBy("labelled").agg(F.min("good").alias("good"), F.max("good").alias("most")).where("good = most").select("labelled", "good", F.xxhash64("labelled").alias("draw"))
    chosen = [judged.where(F.col("good") == g).orderBy("draw", "labelled").limit(sample) for g in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''").join(chosen, F.col("doc_id") == F.col("labelled"))
    texts = texts.groupBy("labelled", "good", "draw").agg(F.min("text").alias("text"))
    order = Window.partitionBy("good").orderBy("draw", "labelled")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = texts.withColumn("before", before).where(F.col("before") <= sample_bytes).orderBy("draw", "labelled").select("good", "text").collect()
    train, held = {0: [], 1: []}, {0: [], 1: []}
    for row in rows:
        side = train if len(train[row.good]) <= len(held[row.good]) else held
        side[row.good].append(row.text.encode())
    if min(map(len, [*train.values(), *held.values()])) < 1:
        return None
    good, bad = dictionary(train[1]), dictionary(train[0])
    pair = _compressor(good), _compressor(bad)
    x = np.array([margin(t, *pair) for g in (0, 1) for t in held[g]])
    y = np.array([g for g in (0, 1) for _ in held[g]], float)
    slope, offset = logistic(x, y)
    return Model(good, bad, slope, offset, float(np.quantile(probability(x[y == 1], slope, offset), 1 - keep_good, method="lower")))


def probability(x: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return np.round(1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30))), 6)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, margin, score, keep) of each row: the margin, the probability that the text is good, and whether it reaches the model's threshold.

    The whole text counts. Null and empty texts, and all texts where there is no model, have a null margin and score, and
    keep is null. Null ids and rows that repeat are scored like others; further columns are ignored. An empty table gives no
    rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pair = model.compressors() if model else None
        for batch in batches:
            for part in slices(batch):
                data, at = view(part.column("text"))
                raw, at = data.tobytes(), at.tolist()
                x = np.array([margin(raw[s:e], *pair) if pair and s < e else np.nan for s, e in zip(at, at[1:])])
                p = probability(x, model.slope, model.offset) if model else x
                none = np.isnan(x)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(x, 6), mask=none), pa.array(p, mask=none), pa.array(p >= (model.threshold if model else 0), mask=none)], ["doc_id", "margin", "score", "keep"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), judge, "doc_id long, margin double, score double, keep boolean")
