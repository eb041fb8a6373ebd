"""Dense vectors: cosine scores as matrix products per batch, and a batched encoder hook.

A cosine of something that is no vector is 0: a null, an empty or a zero vector, one with null or non-finite components, or two
vectors of different lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rosterank.functions.basics import exact_round, once

#: Numbers of one product that a task holds at a time.
PRODUCT_CELLS = 4 << 20


def sound_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the vectors with ``dim`` sound components, and their lengths; zeros for all others."""
    out, lengths = np.zeros((len(vectors), dim)), np.zeros(len(vectors))
    vectors = vectors.cast(pa.list_(pa.float64()))
    starts = vectors.offsets.to_numpy()
    fits = np.flatnonzero((np.diff(starts) == dim) & vectors.is_valid().to_numpy(zero_copy_only=False))
    if dim and len(fits):
        flat = vectors.values.to_numpy(zero_copy_only=False)  # null components are NaN
        rows = flat[starts[fits][:, None] + np.arange(dim)]
        length = np.sqrt((rows * rows).sum(1))
        sound = np.isfinite(length) & (length > 0)
        out[fits[sound]], lengths[fits[sound]] = rows[sound], length[sound]
    return out, lengths


def _divided(dots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)


def with_cosines(rows: DataFrame, references: DataFrame, *, key: str, of: str, ids: str, vector: str, output: str) -> DataFrame:
    """``rows`` with ``output``, an array of the cosines of ``vector`` and the references whose ``key`` is listed in ``ids``.

    ``references`` (``key``, ``of``: their vectors) are a few thousand descriptions at most: the caller's block bounds them.
    Each batch of rows is one product with all of them, in pieces of PRODUCT_CELLS numbers.
    """
    known = references.select(key, F.col(of).cast("array<double>")).collect()
    place = {r[0]: n for n, r in enumerate(known)}
    dims = sorted({len(r[1]) for r in known if r[1]})
    # one matrix per length of vector: of a reference of another length the columns are zeros
    held = [(dim, *sound_rows(pa.array([r[1] for r in known], pa.list_(pa.float64())), dim)) for dim in dims]
    fields = rows.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, PRODUCT_CELLS // max(1, len(place)))
            for batch in (whole.slice(at, step) for at in range(0, len(whole), step)):
                found = np.zeros((len(batch), len(place)))
                for dim, matrix, lengths in held:
                    own, own_lengths = sound_rows(batch.column(vector), dim)
                    found += _divided(own @ matrix.T, own_lengths[:, None] * lengths)
                listed = batch.column(ids).to_pylist()
                values = [None if some is None else [float(row[place[i]]) if i in place else 0.0 for i in some] for some, row in zip(listed, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], names=[*batch.schema.names, output])

    return rows.mapInArrow(work, f"{fields},{output}:array<double>")


def with_cosine(rows: DataFrame, a: str, b: str, output: str) -> DataFrame:
    """``rows`` with the cosine of the vectors ``a`` and ``b`` of each row instead of these."""
    kept = [c for c in rows.columns if c not in (a, b)]
    fields = rows.select(*kept).schema.simpleString().removeprefix("struct<").removesuffix(">")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = {n for n in np.diff(batch.column(a).offsets.to_numpy()).tolist() if n}
            total = np.zeros(len(batch))
            for dim in sorted(sizes):
                (left, of_left), (right, of_right) = sound_rows(batch.column(a), dim), sound_rows(batch.column(b), dim)
                total += _divided((left * right).sum(1), of_left * of_right)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(total)], names=[*kept, output])

    return rows.mapInArrow(work, f"{fields},{output}:double")


def dense_score(cosine: Column) -> Column:
    """Cosine cut at 0 and rounded; unlike the TF-IDF score it is not divided by the pool's best."""
    return once(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(0.0)), lambda score: exact_round(score, 4))


def encode_texts(
    df: DataFrame,
    text_column: str,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    *,
    output: str = "embedding",
    batch_size: int = 256,
) -> DataFrame:
    """Add a vector column. ``make_encoder`` runs once per Python worker and returns texts -> matrix."""
    encode = predict_batch_udf(make_encoder, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(output, encode(F.col(text_column)))
