"""The corpus pipeline over ``documents``: toxicity, line dedup, n-gram Jaccard join, benchmark
decontamination, mixing of sources. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandex.llm import decontam, jaccard, linededup, mixing, toxicity
from strandex.llm.runtime import Tables, opened, read, sweep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with at least this score are rejected, as op9_toxicity predicts.
REJECT = 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the key that a verdict holds for: the id and the text. Rows that repeat both share it, a null id is a value."""
    return docs.withColumn("_row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"), F.length("text").cast("string")))


def _without(docs: DataFrame, bad: DataFrame, key: str, work: Tables, limit: int = 2_000_000) -> DataFrame:
    """``docs`` without the keys in ``bad``, which are broadcast only if they are few (some 40 bytes each)."""
    bad = work.write("bad", bad.select(F.col(key).alias("_bad")).where("_bad IS NOT NULL").distinct())
    bad = F.broadcast(bad) if bad.count() <= limit else bad
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is judged by its text, rows without an id too."""
    scorer, keyed = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")), _keyed(docs)
    found = toxicity.score_texts(keyed, scorer, threshold=REJECT, id_col="_row")
    return _without(keyed, found.where("predicted = 1"), "_row", Tables(spark, "stage1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no line is left go; those that were empty before stay."""
    cleaned = linededup.dedup_lines(docs)
    gone = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", n_chars).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class stays, once if its id repeats (the text that is least).
    Rows without an id are in no class and stay."""
    work = Tables(spark, "stage3")
    found = work.write("classes", jaccard.similar_sets(docs))
    kept = _without(docs, found.where("component_id <> doc_id"), "doc_id", work)
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again"))
    again = work.write("again", again)
    if again.isEmpty():
        return kept
    several, first = kept["doc_id"] == again["_again"], Window.partitionBy("doc_id").orderBy(*[c for c in COLUMNS if c != "doc_id"])
    once = kept.join(again, several, "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.join(again, several, "left_anti").unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is judged by its text, rows without an id too."""
    keyed = _keyed(docs)
    found = decontam.find_leaks(keyed, read(spark, sf_dir, "benchmark"), id_col="_row")
    return _without(keyed, found.where("contaminated"), "_row", Tables(spark, "stage4"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, with the number of copies; documents without words weigh nothing and stay."""
    mixed = mixing.mix_sources(docs)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    return mixed.withColumn("copies", copies).where("copies > 0").select(*COLUMNS, "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]
#: Learned scores and hashed sets have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = read(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        since = opened()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.write(name, docs)
            sweep(since, work)
            work.only(name)
    return docs
