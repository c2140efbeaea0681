"""Scorers of texts: a contract, models that Spark fits from counts, and their blend in one pass over the texts.

A scorer has ``classes`` and ``probabilities(texts)``, a row per text and a column per class.
Its columns are put into one canonical order, so distributions of all scorers compare.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from folio.functions import vectors as V

#: Features are hashed into so many cells: a model holds that many weights per class, whatever it was fitted on.
BUCKETS = 1 << 16
#: Models go to every worker; a larger one is refused.
MOST_BYTES = 256 << 20
MODEL = "name string, kind string, classes array<string>, weights binary"
_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


class Scorer(Protocol):
    classes: list[str]

    def probabilities(self, texts: list[str | None]) -> np.ndarray: ...


def word_cells(text: str) -> np.ndarray:
    """A hashed cell per word, in lower case."""
    words = [w for w in text.translate(_CAPITALS).translate(_SPACES).split(" ") if w]
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in words), np.int64, len(words))


def trigram_cells(text: str) -> np.ndarray:
    """A hashed cell per three characters in a row, in lower case; none below three characters."""
    x = np.frombuffer(text.translate(_CAPITALS).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(x) < 3:
        return np.empty(0, np.int64)
    mixed = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS


CELLS = {"words": word_cells, "trigrams": trigram_cells}


class CountScorer:
    """The mean weight of a text's features per class, sharpened to probabilities; even shares without a feature."""

    def __init__(self, kind: str, classes: list[str], weights: np.ndarray, sharpness: float = 10.0):
        self.kind, self.classes, self.weights, self.sharpness = kind, classes, weights, sharpness

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty((len(texts), len(self.classes)))
        for k, text in enumerate(texts):
            at = CELLS[self.kind](text or "")  # a cell per feature: no pass over all buckets for each text
            s = self.sharpness * self.weights[at].sum(0) / max(len(at), 1)
            e = np.exp(s - s.max())
            out[k] = e / e.sum()
        return out


def to_canonical(p: np.ndarray, classes: list[str], canonical: list[str]) -> np.ndarray:
    """Columns in canonical order; a scorer that lacks a class, or has another, is an error."""
    if sorted(classes) != sorted(canonical):
        raise ValueError(f"classes {sorted(classes)} are not {sorted(canonical)}")
    return p[:, [classes.index(c) for c in canonical]]


def class_counts(rows: DataFrame, text: str, label: str, classes: list[str], kind: str) -> DataFrame:
    """(class, cell, n) over whole texts: at most a row per class and cell.

    Each task adds up its own texts and sends one row per cell that occurs. Rows with a
    null label, or one that is no class, teach nothing; null texts have no features.
    """
    at = {c: k for k, c in enumerate(classes)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(classes), BUCKETS), np.int64)
        for pdf in batches:
            waiting: list[list[np.ndarray]] = [[] for _ in classes]
            for x, y in zip(pdf["t"], pdf["y"], strict=True):
                if y in at:
                    waiting[at[y]].append(CELLS[kind](x or ""))
            for k, cells in enumerate(waiting):
                if cells:
                    sums[k] += np.bincount(np.concatenate(cells), minlength=BUCKETS)
        k, cell = np.nonzero(sums)
        yield pd.DataFrame({"class": k, "cell": cell, "n": sums[k, cell]})

    known = rows.where(F.col(label).isin(*classes)).select(F.col(text).alias("t"), F.col(label).cast("string").alias("y"))
    return known.mapInPandas(count, "class int, cell int, n long").groupBy("class", "cell").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, text: str, label: str, classes: list[str], kind: str, name: str, path: str, smoothing: float = 1.0) -> None:
    """Fit a model by class-against-rest log ratios of smoothed feature shares, and store it at ``path``.

    The driver sees the summed counts only: at most ``len(classes) * BUCKETS`` rows,
    however many texts there are. Without any learnable row all weights are 0.
    """
    n = np.zeros((len(classes), BUCKETS))
    cells = class_counts(rows, text, label, classes, kind).toPandas()
    n[cells["class"], cells["cell"]] = cells["n"]
    rest = n.sum(0) - n
    share = lambda x: np.log((x + smoothing) / (x.sum(1, keepdims=True) + smoothing * BUCKETS))
    held = io.BytesIO()
    np.savez_compressed(held, weights=(share(n) - share(rest)).T)
    rows.sparkSession.createDataFrame([(name, kind, list(classes), held.getvalue())], MODEL).coalesce(1).write.mode("overwrite").parquet(path)


@lru_cache(maxsize=16)
def _loaded(kind: str, classes: tuple[str, ...], weights: bytes) -> CountScorer:
    """A model once per worker process, however many batches it scores."""
    with np.load(io.BytesIO(weights)) as z:
        return CountScorer(kind, list(classes), z["weights"])


def load(spark: SparkSession, path: str) -> dict:
    """A stored model, ready to be sent; its size is looked at before its bytes are read."""
    stored = spark.read.schema(MODEL).parquet(path)
    size = stored.agg(F.sum(F.octet_length("weights"))).first()[0]
    if size is None or size > MOST_BYTES:
        raise ValueError(f"the model at {path} has {size} bytes, the limit is {MOST_BYTES}")
    return stored.first().asDict()


def score(rows: DataFrame, text: str, models: list[dict], canonical: list[str]) -> DataFrame:
    """The rows with an array column ``p_<name>`` per model, its classes in canonical order.

    All models see a text in one pass. Classes are compared before any text is read.
    """
    for m in models:
        to_canonical(np.zeros((0, len(m["classes"]))), list(m["classes"]), canonical)
    sent = rows.sparkSession.sparkContext.broadcast([(m["name"], m["kind"], tuple(m["classes"]), bytes(m["weights"])) for m in models])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers: list[tuple[str, Scorer]] = [(name, _loaded(kind, classes, weights)) for name, kind, classes, weights in sent.value]
        for pdf in batches:
            texts = [x if isinstance(x, str) else None for x in pdf[text]]
            yield pdf.assign(**{f"p_{name}": list(to_canonical(s.probabilities(texts), s.classes, canonical)) for name, s in scorers})

    schema = StructType([*rows.schema.fields, *(StructField(f"p_{m['name']}", ArrayType(DoubleType())) for m in models)])
    return rows.mapInPandas(run, schema)


def ensemble(rows: DataFrame, text: str, models: list[tuple[dict, float]], canonical: list[str]) -> DataFrame:
    """The rows with ``p_<name>`` per model and their weighted mean ``probs``; weights are made to sum to one."""
    scored = score(rows, text, [m for m, _ in models], canonical)
    return scored.withColumn("probs", V.blend([(F.col(f"p_{m['name']}"), w) for m, w in models]))
