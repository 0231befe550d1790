"""Document quality by nearest-neighbour voting in a latent-semantic space.

Fitting takes a bounded sample of labelled rows (``SAMPLE`` of smallest id hash).  Their
features, hashed words and word shapes weighted by tf-idf next to a few measures of the
text as a whole, go through a truncated SVD; the latent vectors and labels of the sample
are broadcast (``SAMPLE`` x ``RANK`` numbers).  Every document is projected the same way,
compared with all labelled vectors by exact cosine products, a block of documents at a
time, and scored by the labels of its ``NEIGHBOURS`` nearest, weighted by similarity.

Only the text is ever looked at.  Null and empty texts have the features of no words and
are scored like any other.  Rows without a label, with a null label or id don't train;
repeated label rows count as often as they are listed, within the bounded sample.  If
nothing is labelled every score is 0.5.  Repeated rows stay repeated; null ids have a
null ``held_out``.  Similarities are rounded to five digits and ties settled by the order of
the labelled rows (id, label, text hash).  Words and texts of any length are read whole.
Other columns stay, but ``score`` and ``predicted`` give way to the new ones.
"""
from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import Memo, hash_sample, worker_state

SAMPLE = 4_096
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
WORD_DIMS, SHAPE_DIMS = 1_024, 512
SHARPNESS = 4
BLOCK_ROWS = 256  # rows weighed at a time when fitting

_RUNS = re.compile(r"[^\W\d_]+|\d+|(.)\1+", re.S)  # runs of letters, digits and repeated marks


def _mark(run: re.Match) -> str:
    if run[1]:
        return run[1] + "+"
    return "0" if run[0][0].isdecimal() else "w" if run[0] != run[0].upper() else "W"


def shape(word: str) -> str:
    """Shape of a whole word: each run of letters is w (some in lower case) or W, of digits 0, of a repeated mark the mark and +."""
    return _RUNS.sub(_mark, word)


def _places(word: str) -> tuple[int, int]:
    lower = word.lower().encode()
    return zlib.crc32(lower) % WORD_DIMS, WORD_DIMS + zlib.crc32(shape(word).encode()) % SHAPE_DIMS


def measures(text: str, words: list[str]) -> list[float]:
    """Measures of the text as a whole, each between 0 and 1."""
    n, lines = max(len(text), 1), [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    capitals = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    digits = sum(map(len, re.findall(r"\d+", text)))
    return [
        letters / n, capitals / max(letters, 1), digits / n, len(set(words)) / max(len(words), 1),
        len(set(lines)) / max(len(lines), 1), min(1.0, np.log1p(len(words)) / 10), min(1.0, n / max(len(words), 1) / 20),
        min(1.0, len(lines) / max(len(words), 1)),
    ]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by hashed word and shape, and measures, of a block of texts."""
    counts = np.zeros((len(texts), WORD_DIMS + SHAPE_DIMS), np.float32)
    whole = np.zeros((len(texts), 8), np.float32)
    places = worker_state("quality", None, lambda: Memo(_places, 200_000))
    for k, text in enumerate(texts):
        words = text.split()
        whole[k] = measures(text, words)
        if words:
            at = np.array(list(map(places.__getitem__, words)), np.int64).ravel()
            counts[k] = np.bincount(at, minlength=counts.shape[1])
    return counts, whole


@dataclass
class Model:
    """Everything a document is scored with; a few megabytes whatever the corpus."""

    idf: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weigh(self, counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
        words, shapes = (np.log1p(counts) * self.idf)[:, :WORD_DIMS], (counts * self.idf)[:, WORD_DIMS:]
        parts = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) for x in (words, np.sqrt(shapes))]
        return np.hstack([0.5 * parts[0], parts[1], (whole - self.centre) / self.spread / 4]).astype(np.float32)

    def project(self, weighed: np.ndarray) -> np.ndarray:
        latent = weighed @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = np.round((self.project(self.weigh(*features(texts))) @ self.vectors.T).astype(np.float64), 5)
        k = min(NEIGHBOURS, near.shape[1])
        # Of equal similarities the earlier labelled row counts: those above the last one, then the first at it.
        last = -np.partition(-near, k - 1, axis=1)[:, k - 1:k]
        rank = np.where(near > last, 0, np.where(near == last, 1, 2)).astype(np.int8)
        best = np.argsort(rank, axis=1, kind="stable")[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 1e-6) ** SHARPNESS
        return np.clip((weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Latent vectors of labelled texts by a randomised truncated SVD (fixed seed)."""
    counts, whole = features(texts)
    n, dims = len(texts), counts.shape[1]
    if not n:
        empty = np.zeros((0, RANK), np.float32)
        return Model(np.ones(dims, np.float32), np.zeros(8, np.float32), np.ones(8, np.float32),
                     np.zeros((dims + 8, RANK), np.float32), empty, np.zeros(0))
    idf = (np.log((1 + n) / (1 + np.count_nonzero(counts, axis=0))) + 0.2).astype(np.float32)
    model = Model(idf, whole.mean(axis=0), np.maximum(whole.std(axis=0), 1e-3), None, None, np.asarray(labels, np.float64))
    # Weighed a block at a time: the steps between would each be as large as the counts.
    x = np.empty((n, dims + whole.shape[1]), np.float32)
    for at in range(0, n, BLOCK_ROWS):
        x[at:at + BLOCK_ROWS] = model.weigh(counts[at:at + BLOCK_ROWS], whole[at:at + BLOCK_ROWS])
    del counts
    y = x @ np.random.default_rng(7).standard_normal((x.shape[1], min(RANK + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    model.basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:RANK].T.copy()
    model.vectors = model.project(x)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows that are not held out.

    The sample is picked from the label rows alone, so only its texts travel; one task fits.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    chosen = F.broadcast(hash_sample(usable, "label_id", sample))
    # Ids may repeat in either table; the order makes the bounded choice, and the fit, the same in every run.
    rows = docs.join(chosen, docs["doc_id"].cast("long") == chosen["label_id"]).select("label_id", "quality", "text").orderBy(
        "label_id", "quality", F.xxhash64("text")).limit(sample).select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, quality = [], []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            quality += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, quality))], pa.binary())], names=["model"])

    fitted = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else fit([], [])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted`` (existing ones of these names give way)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(shared.value.score([t if isinstance(t, str) else "" for t in texts]))

    return kept.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
