"""Aggregates over vectors and repeated samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def vector_mean(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, pos, mean): element-wise mean of the vectors of a key, in long form."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def collected(long: DataFrame, keys: Sequence[str], name: str = "vector") -> DataFrame:
    """Long form back to one array per key."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda x: x["mean"]).alias(name))


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores (n - 1) of the columns; those that don't vary are dropped. One pass for the moments."""
    moments = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    keep = [c for c in columns if moments[f"s_{c}"]]
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[((F.col(c) - F.lit(moments[f"m_{c}"])) / F.lit(moments[f"s_{c}"])).alias(c) for c in keep])


def gram(df: DataFrame, vector: str, size: int | None = None) -> DataFrame:
    """(i, j, value) for i <= j: sums of products of the elements, or of the first ``size``. Outer products are
    summed in each partition; the widest vector gives the width. A null or missing element adds nothing; a
    cell without any product is null."""

    def run(batches):
        total = count = np.zeros((0, 0))
        for batch in batches:
            column = batch.column(0).drop_null()
            lengths = np.diff(column.offsets.to_numpy())
            width = min(size or int(lengths.max(initial=0)), int(lengths.max(initial=0)))
            if width > len(total):
                total, count = (np.pad(m, (0, width - len(m))) for m in (total, count))
            flat = column.flatten().cast(pa.float64())
            values = flat.to_numpy(zero_copy_only=False)
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            used = there & (place < width)
            x, m = np.zeros((2, len(lengths), width))
            x[row[used], place[used]], m[row[used], place[used]] = values[used], 1.0
            total[:width, :width] += x.T @ x
            count[:width, :width] += m.T @ m
        i, j = np.triu_indices(len(total))
        n = count[i, j]
        value = pa.array(total[i, j], mask=n == 0)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), value], names=["i", "j", "value"])

    return df.select(vector).mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def longest(*texts: Column) -> Column:
    """Greatest length of the columns in a group."""
    return F.max(F.greatest(*[F.coalesce(F.length(t), F.lit(0)) for t in texts], F.lit(0)))
