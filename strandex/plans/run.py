"""Life of an association run: shard, resume, test, write, merge."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandex.functions.models import parse_setting, parse_tests
from strandex.operators import cohort, extract, fdr, grouped
from strandex.sources import sinks, tables


def pending(genes: DataFrame, done: DataFrame | None, overwrite: bool = False) -> DataFrame:
    """Genes without a written result."""
    return genes if done is None or overwrite else genes.join(done.select("gene_id").distinct(), "gene_id", "left_anti")


def merged(results: DataFrame, genes: DataFrame, p_columns: Sequence[str] = ("p_F", "p_LRT"), partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """All results with q-values, and the genes without any. Stays in DataFrame operations; two counts
    guard it: missing genes unless ``partial``, and repeated keys."""
    missing = genes.select("gene_id").join(results.select("gene_id").distinct(), "gene_id", "left_anti")
    if not partial and (n := missing.count()):
        raise ValueError(f"{n} genes have no result; merge partially or finish the run")
    found = results.join(genes.select("gene_id"), "gene_id", "left_semi")
    if cohort.repeated_keys(found, grouped.KEYS).head(1):
        raise ValueError("result keys are repeated")
    return fdr.with_q_values(found, p_columns), missing


def run(spark: SparkSession, out: str, genes: DataFrame, features: DataFrame, people: DataFrame, settings: Sequence[str], tests: str = "F", rank: int = 0, world: int = 1, overwrite: bool = False, cell: DataFrame | None = None, cell_settings: Sequence[str] = ("none",), most: int | None = None, **options) -> None:
    """Tests this rank's pending genes and appends their rows to <out>/results. ``most`` bounds the components."""
    manifest = {"settings": list(settings), "tests": tests, "cell_settings": list(cell_settings), "most": most, "options": {k: list(v) if isinstance(v, tuple) else v for k, v in options.items()}, "genes": genes.count(), "version": 1}
    sinks.write_manifest(spark, f"{out}/run_manifest.json", manifest)
    done = _read_or_none(spark, f"{out}/results")
    todo = pending(cohort.shard(genes, rank, world, "ordinal"), done, overwrite)
    chosen = features.join(cohort.small(todo.select("gene_id")), "gene_id", "left_semi")
    rows = grouped.associate(chosen, people, [parse_setting(s, most) for s in settings], parse_tests(tests), cell=cell, cell_settings=[parse_setting(s, most) for s in cell_settings], **options)
    absent = grouped.empty_groups(todo, features, people).withColumn("error", F.lit("no participant of the cohort"))
    sinks.write_results(rows.unionByName(absent.select("gene_id", "status", "error"), allowMissingColumns=True), f"{out}/results", overwrite=overwrite)


def merge(spark: SparkSession, out: str, genes: DataFrame, partial: bool = False) -> None:
    results, missing = merged(spark.read.parquet(f"{out}/results"), genes, partial=partial)
    sinks.write_file(results, f"{out}/merged.tsv", "gene_id")
    sinks.write_file(missing, f"{out}/missing_genes.tsv", "gene_id")


def extract_embeddings(spark: SparkSession, out: str, genes: DataFrame, sequences: DataFrame, make_model=None, rank: int = 0, world: int = 1, overwrite: bool = False, package: extract.Limits = extract.Limits()) -> DataFrame:
    """Embeds this rank's pending genes into <out>/embeddings; returns the genes without sequences."""
    done = _read_or_none(spark, f"{out}/embeddings")
    todo = pending(cohort.shard(genes, rank, world, "ordinal"), done, overwrite)
    rows = extract.embed(sequences.join(cohort.small(todo.select("gene_id")), "gene_id", "left_semi"), make_model, package)
    sinks.write_results(rows, f"{out}/embeddings", overwrite=overwrite)
    return todo.select("gene_id").join(sequences.select("gene_id").distinct(), "gene_id", "left_anti")


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:  # nothing written so far
        if not any(x in str(error) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandex")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "merge", "extract"):
        p = sub.add_parser(name)
        p.add_argument("--genes", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--partial", action="store_true")
        if name == "extract":
            p.add_argument("--sequences", required=True, help="Parquet: gene_id, ref_seq, haplotypes, participant_id")
            p.add_argument("--model", help="module:function that returns the model; a deterministic stand-in without it")
            p.add_argument("--package", help="file name of the packaged model, which tells its limits")
        if name != "merge":
            p.add_argument("--rank", type=int, default=0)
            p.add_argument("--world", type=int, default=1)
            p.add_argument("--overwrite", action="store_true")
        if name == "run":
            p.add_argument("--features", required=True, help="Parquet: gene_id, embed_type, participant_id, vector")
            p.add_argument("--cohort", required=True)
            p.add_argument("--label", required=True)
            p.add_argument("--covariates", default="age,sex")
            p.add_argument("--sex", default="All", choices=("All", "F", "M"))
            p.add_argument("--pca", default="fixed:50", help="comma-separated settings")
            p.add_argument("--tests", default="F")
            p.add_argument("--pca-max", type=int, help="most components of a variance setting")
            p.add_argument("--participants", help="list of the ids to test; all must be in the cohort")
            p.add_argument("--expected", type=int, help="participants that every gene must have")
            p.add_argument("--cell", help="Parquet: an id column and the cell embedding")
            p.add_argument("--cell-pca", default="none", help="comma-separated settings, none without cell components")
            p.add_argument("--max-iter", type=int, default=100)
            p.add_argument("--tol", type=float, default=1e-10)
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandex").getOrCreate()
    genes = tables.read_ids(spark, args.genes)
    if args.command == "merge":
        return merge(spark, args.out, genes, args.partial)
    if args.command == "extract":
        module, _, function = (args.model or "").partition(":")
        make = getattr(importlib.import_module(module), function) if module else None
        absent = extract_embeddings(spark, args.out, genes, tables.sequences(spark.read.parquet(args.sequences)), make, args.rank, args.world, args.overwrite, extract.limits(args.package) if args.package else extract.Limits())
        return print(f"{absent.count()} genes have no sequences")
    names = [c for c in args.covariates.split(",") if c]
    raw = spark.read.option("header", True).option("sep", "\t").csv(args.cohort)
    people = cohort.read_cohort(raw, args.label, names, args.sex).withColumnRenamed(args.label, "label")
    if args.participants:
        people = cohort.allow(people, tables.read_ids(spark, args.participants).select(F.col("gene_id").cast("long").alias("participant_id")), "participant_id")
    cell = tables.cell_vectors(spark.read.parquet(args.cell)) if args.cell else None
    cell_settings = args.cell_pca.split(",") if args.cell else ["none"]
    run(spark, args.out, genes, spark.read.parquet(args.features), people, args.pca.split(","), args.tests, args.rank, args.world, args.overwrite, cell, cell_settings, most=args.pca_max, expected=args.expected, max_iter=args.max_iter, tol=args.tol, covariates=cohort.covariates(names, args.label, args.sex), sex=args.sex, trait=args.label)


if __name__ == "__main__":
    main()
