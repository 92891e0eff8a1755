"""Sources: identifier lists, cohorts, sequences, embeddings, result lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strandex.operators import cohort

# Names that stand for the same column, by precedence.
ID_HEADERS = ("gene_id", "gene_ids", "geneid", "gene", "ensembl_id", "ensembl_gene_id")
SAMPLE_KEYS = ("participant_id", "subject_id", "dosage")
EMBEDDING_KEYS = ("participant_id", "participant_ids", "subject_id", "subject_ids")
CELL_FIELDS = ("cell_embedding", "cell_embeddings", "embedding", "embeddings", "X")
HAPLOTYPES = ("mutation_seq", "mutated_seq", "variant_seq")
LIST_FILE = r"([^/]+?)_extreme(?:_([FM]))?\.tsv"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, gene_id) of a tab-separated list: # starts a comment, the header is optional, and
    keys are trimmed, distinct and in order. A list is small; its lines are numbered in one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    cells = lines.select("n", F.split(F.regexp_replace("line", "#.*", ""), "\t").alias("cells")).where(F.exists("cells", lambda c: F.trim(c) != ""))
    first = cells.orderBy("n").first()
    if first is None:
        raise ValueError("the list is empty")
    head = [c.strip().lower() for c in first["cells"]]
    at = next((head.index(h) for h in ID_HEADERS if h in head), None)
    rows = cells.where(F.col("n") > first["n"]) if at is not None else cells
    out = cohort.first_seen(rows.select(F.col("n").alias("line"), F.get("cells", F.lit(at or 0)).alias("gene_id")), "gene_id", "line")
    if bad := cohort.bad_ids(out, "gene_id").head(3):
        raise ValueError(f"ids with a slash: {[r['gene_id'] for r in bad]}")
    return cohort.ordinals(out, ["line"]).select("ordinal", "gene_id")


def read_table(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]], sep: str = "\t") -> DataFrame:
    """A delimited file by its header: the named columns, cast; text that doesn't cast fails the job."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    cohort.require(df, [f for f, _ in fields])
    return df.select(*[F.col(f).cast(t).alias(f) for f, t in fields])


def pick(columns: Sequence[str], names: Sequence[str]) -> str:
    """The first of the names that is a column."""
    found = next((n for n in names if n in columns), None)
    if found is None:
        raise ValueError(f"none of {list(names)} is a column")
    return found


def sequences(df: DataFrame) -> DataFrame:
    """subject, ref_seq, hap1, hap2 of a sequence table, whatever its column names; a missing
    haplotype column is the plain variant_seq."""
    haplotype = lambda k: pick(df.columns, [f"{h}_{k}" for h in HAPLOTYPES] + ["variant_seq"])
    rest = [c for c in ("gene_id",) if c in df.columns]
    return df.select(*rest, F.col(pick(df.columns, SAMPLE_KEYS)).cast("string").alias("subject"), "ref_seq", F.col(haplotype(1)).alias("hap1"), F.col(haplotype(2)).alias("hap2"))


def cell_vectors(df: DataFrame) -> DataFrame:
    """(participant_id, cell_vector): mean of repeated samples, finite vectors only; a number is a vector of one."""
    from strandex.functions.vectors import all_finite
    from strandex.operators.aggregates import collected, vector_mean

    key, name = pick(df.columns, EMBEDDING_KEYS), pick(df.columns, CELL_FIELDS)
    value = F.col(name) if isinstance(df.schema[name].dataType, T.ArrayType) else F.array(name)
    subject = cohort.subject_id(F.col(key).cast("string")) if key.startswith("subject") else F.col(key).cast("long")
    means = collected(vector_mean(df.select(subject.alias("participant_id"), value.cast("array<double>").alias("v")), ["participant_id"], "v"), ["participant_id"], "cell_vector")
    return means.where(all_finite(F.col("cell_vector")))


def long_embeddings(df: DataFrame, names: Sequence[str], id_col: str | None = None) -> DataFrame:
    """gene_id, embed_type, participant_id, vector: the named embeddings of a table with one column per field.

    Stored columns are taken as they are; others are derived from the track fields by name.
    """
    from strandex.functions.vectors import embedding

    key = id_col or pick(df.columns, EMBEDDING_KEYS)
    subject = cohort.subject_id(F.col(key).cast("string")) if key.startswith("subject") else F.col(key).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("embed_type"), embedding(n, df.columns).cast("array<double>").alias("vector")) for n in names]))
    return df.select("gene_id", subject.alias("participant_id"), each.alias("e")).select("gene_id", "e.embed_type", "participant_id", "e.vector")


def repeated_features(df: DataFrame) -> DataFrame:
    """Genes whose features come from more than one file: a gene has one place, or the result is undefined."""
    return df.select("gene_id", F.input_file_name().alias("file")).distinct().groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """gene_id (the file's name), participant_id, field, vector of .npz files of matrices, without pickles.

    Files are read where they lie, each by one task, row by row. Ids come from the first id field;
    numeric matrices with as many rows are fields, others are left out.
    """
    import io

    import numpy as np
    import pandas as pd

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                gene = name.rsplit("/", 1)[-1].removesuffix(".npz")
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    key = pick(data.files, EMBEDDING_KEYS)
                    ids = [str(x).split("_")[0] if key.startswith("subject") else str(x) for x in data[key].reshape(-1)]
                    for field in data.files:
                        x = data[field]
                        if field != key and x.ndim == 2 and len(x) == len(ids) and x.shape[1] and x.dtype.kind in "fiu":
                            yield pd.DataFrame({"gene_id": gene, "participant_id": [int(i) for i in ids], "field": field, "vector": x.astype(np.float64).tolist()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, "gene_id string, participant_id long, field string, vector array<double>")


def result_lists(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all <trait>_extreme[_F|_M].tsv below a folder, with trait and stratum from the file name.
    The p column may be named p_F or p_F_analytic."""
    schema = "gene_id string, num_feature int, embed_type string, F_obs double, p_F double"
    df = spark.read.option("header", True).option("sep", "\t").option("enforceSchema", True).option("pathGlobFilter", "*_extreme*.tsv").schema(schema).csv(path)
    name = F.input_file_name()
    return df.withColumn("trait", F.regexp_extract(name, LIST_FILE, 1)).withColumn("stratum", F.coalesce(F.nullif(F.regexp_extract(name, LIST_FILE, 2), F.lit("")), F.lit("All")))
