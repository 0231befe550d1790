"""Nearest exemplar by cosine similarity: a theta join with top-1 per item."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exemplars are a configuration-sized table.  Up to this many float64 cells (64 MB) one
# matrix travels to every executor; larger tables go through the blocked way, with the same result.
BROADCAST_CELLS = 8_000_000
GROUP_ITEMS = 20_000
# Scores are worked out in tiles of so many items and exemplars (8 MB).
TILE = 1_000
KEYS = ["category", "niche", "example_idx"]
# Scores are compared at nine digits so that equal vectors tie whatever the summation order.
DIGITS = 9

RESULT = [
    T.StructField("nearest_category", T.StringType()),
    T.StructField("nearest_niche", T.StringType()),
    T.StructField("nearest_idx", T.IntegerType()),
    T.StructField("similarity", T.DoubleType()),
]


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _best(items: np.ndarray, exemplars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and score of the best exemplar per item, tile by tile; the first of equal scores wins."""
    pick, best = np.zeros(len(items), np.int64), np.full(len(items), -np.inf)
    for i in range(0, len(items), TILE):
        some = _unit(items[i:i + TILE])
        for j in range(0, len(exemplars), TILE):
            scores = np.round(some @ exemplars[j:j + TILE].T, DIGITS)
            place = scores.argmax(axis=1)
            score = scores[np.arange(len(some)), place]
            better = score > best[i:i + TILE]
            pick[i:i + TILE][better], best[i:i + TILE][better] = j + place[better], score[better]
    return pick, best


def _by_length(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the usable vectors of each length; those that are null, empty or hold a null are left out."""
    places: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        if v is not None and len(v) and not any(x is None or x != x for x in v):
            places.setdefault(len(v), []).append(k)
    return {n: (np.array(p), np.array([vectors[k] for k in p], np.float64)) for n, p in places.items()}


def _match(vectors: list, exemplars: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Exemplar place (-1: none of its length) and score of every vector."""
    pick, best = np.full(len(vectors), -1), np.zeros(len(vectors))
    for n, (rows, matrix) in _by_length(vectors).items():
        if n in exemplars:
            names, units = exemplars[n]
            at, best[rows] = _best(matrix, units)
            pick[rows] = names[at]
    return pick, best


def nearest_exemplar(
    items: DataFrame, exemplars: DataFrame, row_id: str, vector: str = "embedding", cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """Items with the category, niche, index and similarity of their nearest exemplar.

    Vectors are compared with exemplars of their own length.  Ties go to the first
    (category, niche, example_idx).  Items without a usable vector, or without an
    exemplar of that length, get NULLs.  Exemplars travel whole up to ``cells`` numbers
    and in blocks beyond that.
    """
    exemplars = exemplars.filter(F.size("embedding") > 0)
    total = exemplars.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("n")).first()["n"]
    if total == 0:
        return items.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in RESULT])
    if total <= cells:
        return _by_broadcast(items, exemplars, vector)
    return _by_blocks(items, exemplars, row_id, vector, math.ceil(total / cells) * 2)


def _by_broadcast(items: DataFrame, exemplars: DataFrame, vector: str) -> DataFrame:
    rows = exemplars.select(*KEYS, "embedding").collect()
    rows.sort(key=lambda r: tuple(r[k] for k in KEYS))
    names = [[r[k] for r in rows] for k in KEYS]
    matrices = {n: (at, _unit(m)) for n, (at, m) in _by_length([r["embedding"] for r in rows]).items()}
    shared = items.sparkSession.sparkContext.broadcast((names, matrices))
    position = items.columns.index(vector)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cats, niches, idxs), known = shared.value
        for batch in batches:
            pick, best = _match(batch.column(position).to_pylist(), known)
            none = pick < 0
            where = pa.array(np.where(none, 0, pick), mask=none)
            extra = [
                pa.array(cats, pa.string()).take(where), pa.array(niches, pa.string()).take(where),
                pa.array(idxs, pa.int32()).take(where), pa.array(best, pa.float64(), mask=none),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *extra], names=[*batch.schema.names, *[f.name for f in RESULT]]
            )

    return items.mapInArrow(score, T.StructType(items.schema.fields + RESULT))


def _by_blocks(items: DataFrame, exemplars: DataFrame, row_id: str, vector: str, blocks: int) -> DataFrame:
    """Exemplar blocks of bounded size meet item groups of bounded size; the best block wins per item."""
    salts = max(1, math.ceil(items.count() / GROUP_ITEMS))
    placed = exemplars.select(*KEYS, "embedding").withColumn("block", F.pmod(F.xxhash64(*KEYS), F.lit(blocks)).cast("int"))
    occupied = placed.select("block").distinct()
    left = (
        items.select(F.col(row_id).alias("_id"), F.col(vector).alias("embedding")).filter(F.size("embedding") > 0)
        .withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .join(occupied, "block", "left_semi")
    )
    right = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def score(group: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(KEYS, kind="stable").reset_index(drop=True)
        known = {n: (at, _unit(m)) for n, (at, m) in _by_length(block["embedding"].tolist()).items()}
        pick, best = _match(group["embedding"].tolist(), known)
        hit = np.flatnonzero(pick >= 0)
        chosen = block.iloc[pick[hit]]
        return pd.DataFrame({
            "_id": group["_id"].iloc[hit].to_numpy(), "similarity": best[hit],
            **{k: chosen[k].to_numpy(object) for k in KEYS[:2]}, KEYS[2]: chosen[KEYS[2]].to_numpy(np.int32)})

    id_type = dict(items.dtypes)[row_id]
    scored = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInPandas(
        score, f"_id {id_type}, similarity double, category string, niche string, example_idx int"
    )
    best = scored.groupBy("_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), *KEYS)).alias("b")
    ).select(
        F.col("_id").alias(row_id), F.col("b.category").alias("nearest_category"),
        F.col("b.niche").alias("nearest_niche"), F.col("b.example_idx").alias("nearest_idx"),
        (-F.col("b.s")).alias("similarity"),
    )
    return items.join(best, row_id, "left").select(*items.columns, *[f.name for f in RESULT])
