"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text that is like the good examples compresses better with their dictionary than with that of the bad ones.
The whole text is cut into blocks of `BLOCK` bytes, so that a long text doesn't become its own dictionary; every
block is compressed with both. The difference of the two sums, divided by the bytes, is calibrated together with
the logarithm of the mean compressed share (which tells texts that repeat themselves) by a logistic curve that
is fitted to labelled rows whose text is in neither dictionary.

The labels of a bounded sample are used: about `per_class` rows of each class, chosen by the hash of the id, one
excerpt of `excerpt` characters from a place chosen by that hash. Two thirds of them make the dictionaries and
the rest the calibration. Dictionaries are at most `DICTIONARY` bytes each and travel with the task.

Cases: a null or empty text has no difference and gets the calibration's score at 0; a document with several
labels is learnt from by each; null labels are not learnt from; without both classes every score is the share
of label 1 (0.5 without labels); repeated documents are returned row by row; an empty table gives an empty
result; other columns, among them lang, source and doc_id, are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import hash_share, pick
from lexmill.session import table

BLOCK = 1024
DICTIONARY = 128 * 1024
LEVEL = 3
PER_CLASS = 1500
EXCERPT = 2000
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


@dataclass
class Model:
    """Dictionaries, and the calibration: weights of the two inputs and of 1."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]


def _packers(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in (good, bad):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def _measure(texts: list[bytes], packers: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """A row per text: (bytes with the bad dictionary - bytes with the good one) / bytes, and the logarithm of
    the mean of both / bytes; zeros for an empty text."""
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        if not text:
            continue
        good = bad = 0
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            good += len(packers[0].compress(block))
            bad += len(packers[1].compress(block))
        out[i] = (bad - good) / len(text), np.log((good + bad) / 2 / len(text))
    return out


def _calibrated(x: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights[:2]) + weights[2], -30, 30)))


def _dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """Raw content of equal shares of the texts: zstandard finds matches in it anywhere."""
    if not texts:
        return b"\0" * 8
    share = max(64, size // len(texts))
    return b"\n".join(t[:share] for t in texts)[:size].ljust(8, b"\0")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton iterations with a small ridge on standardised inputs."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-12
    design = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    ridge = np.diag([0.1, 0.1, 1e-9])
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:2] / spread
    return float(slopes[0]), float(slopes[1]), float(w[2] - slopes @ mean)


def train(texts: list[str], quality: list[int]) -> Model:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    y = np.array(quality, float)
    if len(set(quality)) < 2:
        share = y.mean() if len(y) else 0.5
        return Model(b"\0" * 8, b"\0" * 8, (0.0, 0.0, float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -13, 13))))
    calibrate = np.arange(len(raw)) % 3 == 0
    good = _dictionary([t for t, q, c in zip(raw, quality, calibrate, strict=True) if q == 1 and not c])
    bad = _dictionary([t for t, q, c in zip(raw, quality, calibrate, strict=True) if q != 1 and not c])
    x = _measure([t for t, c in zip(raw, calibrate, strict=True) if c], _packers(good, bad))
    return Model(good, bad, _logistic(x, y[calibrate]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, excerpt: int = EXCERPT) -> Model:
    known = pick(labels, label_id="doc_id", quality="quality").filter(F.col("quality").isNotNull() & ~held_out(F.col("label_id")))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], [])
    share = F.create_map(*[F.lit(x) for q, n in counts.items() for x in (q, min(1.0, per_class / n))])
    chosen = known.filter(hash_share(F.col("label_id"), 17) < share[F.col("quality")]).limit(4 * per_class * len(counts))
    place = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.greatest(F.length("text") - excerpt, F.lit(1)).cast("long")).cast("int") + 1
    sample = (
        pick(docs, doc_id="doc_id", text="text")
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # at most 4 * per_class rows of each class
        .select("doc_id", F.col("quality").cast("int").alias("quality"), F.substr("text", place, F.lit(excerpt)).alias("t"))
        .toPandas()
        .sort_values(["doc_id", "quality", "t"], kind="stable")
    )
    return train(list(sample["t"]), [int(q) for q in sample["quality"]])


def _scorer(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = _packers(model.good, model.bad)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            score = _calibrated(_measure(texts, packers), model.weights)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    docs = pick(docs, doc_id="doc_id", text="text")
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scorer(model, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    return score(docs, fit(docs, labels, **options), threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
