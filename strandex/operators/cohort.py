"""Identifier lists and cohorts: order, filters, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strandex.functions.vectors import all_of, finite
from strandex.sources import sinks

#: Rows and bytes of a side that is broadcast at most.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def _bytes(c: T.StructField) -> Column:
    if isinstance(c.dataType, T.ArrayType):
        return 8 * F.coalesce(F.size(F.col(f"`{c.name}`")), F.lit(0)).cast("long")
    return F.coalesce(F.octet_length(F.col(f"`{c.name}`")), F.lit(0)).cast("long") if isinstance(c.dataType, T.StringType) else F.lit(8).cast("long")


def small(df: DataFrame, most: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the table is known to be small, in rows and in bytes; else the plain table, joined by a shuffle."""
    row = sum((_bytes(c) for c in df.schema.fields), F.lit(0).cast("long"))
    seen = df.select(row.alias("b")).limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= most and seen["b"] <= size else df


def first_seen(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per trimmed, nonblank key, with the least ordinal: an order-preserving distinct."""
    trimmed = F.trim(F.col(key))
    return df.where(F.coalesce(trimmed, F.lit("")) != "").groupBy(trimmed.alias(key)).agg(F.min(ordinal).alias(ordinal))


def bad_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids with a slash or backslash, which cannot name a file."""
    return df.where(F.col(key).contains("/") | F.col(key).contains("\\"))


def shard(df: DataFrame, rank: int, world: int, ordinal: str) -> DataFrame:
    """Every world-th row by a contiguous ordinal, from ``rank`` on."""
    if not 0 <= rank < world:
        raise ValueError("rank must lie in 0 .. world - 1")
    return df.where(F.pmod(F.col(ordinal), F.lit(world)) == rank)


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in range partitions, whose number is in ``_part``. Written to the shared folder: the ranges come
    from a sample, so that a plan that is run again may cut them elsewhere."""
    path = sinks.scratch(df.sparkSession, "ranged")
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts.write.parquet(path)
    return df.sparkSession.read.schema(parts.schema).parquet(path)


def ordinals(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Contiguous numbers from 0 in the given total order. Rows are numbered inside range partitions
    and shifted by the sizes of the partitions before, so that no task holds more than its own rows."""
    inside = ranged(df, order).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    return inside.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_before") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_before")


def stratum(sex: Column, which: str) -> Column:
    """All: 0 or 1; F: 0; M: 1."""
    codes = {"All": (0, 1), "F": (0,), "M": (1,)}
    if which not in codes:
        raise ValueError(f"no stratum {which!r}")
    return sex.isin(*codes[which])


def covariates(names: Sequence[str], label: str, which: str, sex: str = "sex") -> list[str]:
    """Sex is a covariate only where it varies."""
    out = [n for n in names if n != sex or which == "All"]
    if len(set(out)) < len(out) or label in out:
        raise ValueError("a covariate is repeated or is the label")
    return out


def require(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"columns are missing: {missing}")


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose values are neither null, NaN nor infinite."""
    return df.where(all_of([finite(F.col(c).cast("double")) for c in columns]))


def read_cohort(df: DataFrame, label: str, names: Sequence[str] = (), which: str = "All", id_col: str = "participant_id", sex: str = "sex") -> DataFrame:
    """Id, label, sex and covariates of the complete rows of a stratum; unneeded columns go."""
    names = covariates(names, label, which, sex)
    columns = list(dict.fromkeys([id_col, label, sex, *names]))
    require(df, columns)
    numbers = [F.col(c).cast("long" if c == id_col else "int" if c == sex else "double").alias(c) for c in columns]
    return complete(df.where(stratum(F.col(sex), which)).select(*numbers), columns[1:])


def allow(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with an allowed id; every allowed id must be present."""
    absent = ids.join(df, key, "left_anti").count()
    if absent:
        raise ValueError(f"{absent} requested ids are absent")
    return df.join(small(ids.select(key)), key, "left_semi")


def subject_id(text: Column) -> Column:
    """The number before the first underscore; null if it is none."""
    return F.try_to_number(F.split(text, "_")[0], F.lit("9999999999999999999")).cast("long")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def is_binary(y: Column) -> Column:
    """Both 0 and 1 occur and nothing else (an aggregate)."""
    return (F.min(y) == 0) & (F.max(y) == 1) & (F.count_if(~y.isin(0, 1)) == 0)


def ids_digest(key: Column) -> Column:
    """sha256 of the sorted ids of a group, comma-joined (an aggregate; groups are cohorts)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(key)), ","), 256)


def align(features: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    """Features of the cohort's members with the cohort's columns."""
    return features.join(small(cohort), key)
