"""Benjamini-Hochberg q-values, selection, and replication between result lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandex.functions.vectors import finite
from strandex.operators.cohort import ranged, small

CONFIG = ("embed_type", "gene_pca_id", "cell_pca_id")
#: Fixed value: level below which a result is significant.
LEVEL = 2.5e-6


def q_name(p_column: str) -> str:
    return f"q_{p_column[2:]}_bh" if p_column.startswith("p_") else f"{p_column}_q_bh"


def with_q_values(df: DataFrame, p_columns: Sequence[str], config: Sequence[str] = CONFIG) -> DataFrame:
    """A q-value column for each present p column, within each configuration; nonfinite p give null.

    Rows go to range partitions by configuration and p. Ranks are counted inside a partition and shifted
    by what the configuration has in those before; the least p * m / rank from a row upward is the least
    inside its partition or in those after. A configuration is spread over as many tasks as it needs.
    """
    for p in [c for c in p_columns if c in df.columns]:
        df = df.withColumn("_p", F.when(finite(F.col(p).cast("double")), F.col(p).cast("double")))
        none = df.where(F.col("_p").isNull()).withColumn(q_name(p), F.lit(None).cast("double")).drop("_p")
        table = ranged(df.where(F.col("_p").isNotNull()), [*config, "_p"])
        key = ["_part", *config]
        over, inside = Window.partitionBy(*config).orderBy("_part"), Window.partitionBy(*key)
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key]
        of = lambda parts: parts.withColumnsRenamed({c: f"_of_{c}" for c in key})
        sizes = table.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
        sizes = sizes.withColumn("_m", F.sum("_size").over(Window.partitionBy(*config))).withColumn("_before", F.coalesce(F.sum("_size").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rank = F.col("_before") + F.row_number().over(inside.orderBy("_p"))
        step = table.join(small(of(sizes.drop("_size"))), same).withColumn("_step", F.col("_p") * F.col("_m") / rank).drop("_m", "_before", *[f"_of_{c}" for c in key])
        after = step.groupBy(*key).agg(F.min("_step").alias("_least")).withColumn("_after", F.min("_least").over(over.rowsBetween(1, Window.unboundedFollowing)))
        # From the largest p down: a frame that only grows is summed once, one that shrinks again for each row.
        upward = F.min("_step").over(inside.orderBy(F.desc("_p"), "_step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = step.withColumn("_upward", upward).join(small(of(after.drop("_least"))), same)
        found = found.withColumn(q_name(p), F.least(F.lit(1.0), "_upward", "_after"))  # least() passes over nulls
        df = found.drop("_p", "_step", "_upward", "_after", *[f"_of_{c}" for c in key], "_part").unionByName(none)
    return df


def significant(df: DataFrame, keys: Sequence[str], p: str = "p_F", level: float = LEVEL, ties: Sequence[str] = ("embed_type",)) -> DataFrame:
    """Below the level (strictly), the best row of each key; ties go by the further columns."""
    best = Window.partitionBy(*keys).orderBy(p, *ties)
    return df.where(F.col(p) < level).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def recovery(first: DataFrame, second: DataFrame, stratum: Sequence[str], key: str) -> DataFrame:
    """Each row of the first list, and whether its key is in the second list of the same stratum."""
    other = second.select(*stratum, key).distinct().withColumn("_found", F.lit(True))
    return first.join(other, [*stratum, key], "left").withColumn("recovered", F.coalesce("_found", F.lit(False))).drop("_found")


def recovery_rate(strata: DataFrame, compared: DataFrame, stratum: Sequence[str]) -> DataFrame:
    """Share recovered per stratum; null for a stratum without keys."""
    rates = compared.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("recovered").cast("long")).alias("n_recovered"))
    out = strata.join(rates, list(stratum), "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(*stratum, n.alias("n"), F.coalesce("n_recovered", F.lit(0)).alias("n_recovered"), F.when(n > 0, F.col("n_recovered") / n).alias("rate"))


def partial_f_from_r2(r2_full: Column, r2_reduced: Column, df1: int, df2: Column) -> Column:
    """F of nested linear models by their R squared, where both are of full rank."""
    return ((r2_full - r2_reduced) / df1) / ((1 - r2_full) / df2)
