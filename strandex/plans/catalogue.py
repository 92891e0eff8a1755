"""Named queries of the library over the driver's tables, each with its SQL where SQL can express it.

The tables stand in for genomic data: customers are a cohort (id, label c_acctbal, stratum
c_nationkey modulo 2), embeddings are features, part names are sequences, lineitem keys are genes
with pseudo p-values.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandex.functions import models, sequence, tails, vectors
from strandex.operators import aggregates, cohort, extract, fdr, grouped
from strandex.plans import run as lifecycle
from strandex.sources import sinks, tables
from strandex.streaming import samples

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r6(c):
    return F.round(c, 6)


def _cohort(spark, sf) -> DataFrame:
    c = _t(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("participant_id"), (F.col("c_nationkey") % 2).alias("sex"), F.col("c_acctbal").alias("label"), F.col("c_nationkey").cast("double").alias("age"))


_COHORT = "SELECT c_custkey AS participant_id, c_nationkey % 2 AS sex, c_acctbal AS label, c_nationkey::DOUBLE AS age FROM customer"


# Identifier lists


@_query("SELECT trim(l_shipmode) AS gene_id, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM (SELECT ' ' || l_partkey::VARCHAR || ' ' AS l_shipmode, l_orderkey, l_linenumber FROM lineitem) GROUP BY 1")
def q_gene_list_dedupe(spark, sf):
    l = _t(spark, sf, "lineitem")
    keyed = l.select(F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("gene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return cohort.first_seen(keyed, "gene_id", "ordinal").select("gene_id", F.col("ordinal").cast("long").alias("ordinal"))


@_query("SELECT p_partkey, n FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part) WHERE n % 4 = 1")
def q_rank_shard(spark, sf):
    numbered = cohort.ordinals(_t(spark, sf, "part").select("p_partkey"), ["p_partkey"], "n")
    return cohort.shard(numbered, 1, 4, "n").select("p_partkey", "n")


@_query("SELECT p_partkey FROM part WHERE contains(p_name, '/') OR contains(p_name, chr(92))")
def q_bad_ids(spark, sf):
    return cohort.bad_ids(_t(spark, sf, "part"), "p_name").select("p_partkey")


# Cohorts


def _stratum(which, test):
    def f(spark, sf):
        c = _cohort(spark, sf)
        names = cohort.covariates(["age", "sex"], "label", which)
        return cohort.read_cohort(c, "label", names, which).select("participant_id", "sex", "label", "age")

    f.__name__ = f"q_cohort_stratum_{which.lower()}"
    return _query(f"SELECT participant_id, sex::INT AS sex, label, age FROM ({_COHORT}) WHERE {test}")(f)


for _w, _s in (("All", "sex IN (0, 1)"), ("F", "sex = 0"), ("M", "sex = 1")):
    _stratum(_w, _s)


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0")
def q_complete_case(spark, sf):
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    odd = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit(float("nan"))).when(k % 13 == 0, F.lit(float("-inf"))).otherwise(x)
    return cohort.complete(_t(spark, sf, "customer").select(k, odd.alias("c_acctbal")), ["c_acctbal"])


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q_allow_list_semi(spark, sf):
    wanted = _t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return cohort.allow(_t(spark, sf, "customer"), wanted, "c_custkey").select("c_custkey", "c_name")


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def q_absent_anti(spark, sf):
    seen = _t(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey")


@_query("SELECT event_id, user_id AS subject FROM events")
def q_subject_id_parse(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", cohort.subject_id(F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_id").cast("string"))).alias("subject"))


@_query("SELECT lang, count(*) AS n, coalesce(min(toxic) = 0 AND max(toxic) = 1 AND count(*) FILTER (toxic NOT IN (0, 1)) = 0, false) AS is_binary, count(*) FILTER (toxic = 1) AS n_cases FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def q_binary_label(spark, sf):
    d = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), cohort.is_binary(F.col("toxic")).alias("is_binary"), F.count_if(F.col("toxic") == 1).alias("n_cases"))


@_query(f"SELECT sex::INT AS sex, count(*) AS n, sha256(string_agg(participant_id::VARCHAR, ',' ORDER BY participant_id)) AS digest FROM ({_COHORT}) GROUP BY sex")
def q_cohort_digest(spark, sf):
    return _cohort(spark, sf).groupBy("sex").agg(F.count(F.lit(1)).alias("n"), cohort.ids_digest(F.col("participant_id")).alias("digest"))


@_query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_duplicate_keys(spark, sf):
    return cohort.repeated_keys(_t(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@_query("SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) < 3 THEN 'input_failed' ELSE 'ok' END AS status FROM lineitem GROUP BY l_orderkey")
def q_minimum_cohort(spark, sf):
    n = F.count(F.lit(1))
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(n.alias("n"), F.when(n < grouped.LEAST_PARTICIPANTS, "input_failed").otherwise("ok").alias("status"))


# Alignment and configurations


@_query("SELECT vec_id, quality, toxic, round(embedding[1]::DOUBLE, 6) AS x0 FROM embeddings JOIN labels ON vec_id = doc_id")
def q_feature_align(spark, sf):
    people = _t(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id")
    return cohort.align(_t(spark, sf, "embeddings"), people, "vec_id").select("vec_id", "quality", "toxic", _r6(F.get("embedding", F.lit(0)).cast("double")).alias("x0"))


_TRACK_NAMES = """
WITH t AS (SELECT unnest(['cage', 'dnase', 'atac', 'rnaseq']) AS t, unnest([0, 1, 2, 3]) AS k),
s AS (SELECT m, string_agg(t, '_' ORDER BY k) AS tracks FROM range(1, 16) r(m), t WHERE (m >> k) & 1 = 1 GROUP BY m),
n AS (SELECT mode || '_' || tss || tracks AS name, mode, tss <> '' AS near_start, tracks FROM s, (SELECT unnest(['concat', 'add']) AS mode), (SELECT unnest(['', 'tss_']) AS tss))
"""


def _names(spark) -> DataFrame:
    widths = {vectors.field(t, tss): 2 for t in vectors.TRACKS for tss in (False, True)}
    return spark.createDataFrame([(n,) for n in vectors.embedding_names(widths)], "name string")


@_query(_TRACK_NAMES + "SELECT r_regionkey, name FROM region, n")
def q_config_cross(spark, sf):
    return _t(spark, sf, "region").select("r_regionkey").crossJoin(F.broadcast(_names(spark)))  # both sides are a few rows


@_query(_TRACK_NAMES + "SELECT name || '_pca0.99' AS name, mode, near_start, tracks, '0.99' AS pca FROM n")
def q_embed_name_parse(spark, sf):
    named = _names(spark).select(F.concat("name", F.lit("_pca0.99")).alias("name"))
    mode, tss, tracks, pca = vectors.name_parts(F.col("name"))
    return named.select("name", mode.alias("mode"), tss.alias("near_start"), tracks.alias("tracks"), pca.alias("pca"))


@_query("SELECT 'concat_' || CASE t WHEN 'rnaseq' THEN 'rna_seq' ELSE t END || '_' || r AS field FROM (SELECT unnest(['cage', 'dnase', 'atac', 'rnaseq']) AS t), (SELECT unnest(['mean', 'tss500_mean']) AS r)")
def q_track_fields(spark, sf):
    return spark.createDataFrame([(vectors.field(t, s),) for t in vectors.TRACKS for s in (False, True)], "field string")


@_query("SELECT * FROM (VALUES ('variance_0.9', 'variance', 0.9::DOUBLE), ('fixed_50', 'fixed', 50.0), ('fixed_5_max3', 'fixed', 5.0)) t(id, mode, target)")
def q_pca_settings(spark, sf):
    s = [models.parse_setting("variance:0.9"), models.parse_setting("fixed:50"), models.parse_setting("fixed:5", 3)]
    return spark.createDataFrame([(x.id, x.mode, float(x.target)) for x in s], "id string, mode string, target double")


# Embeddings


def _halves(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return _t(spark, sf, "embeddings").select("vec_id", F.slice(v, 1, 32).alias("concat_cage_mean"), F.slice(v, 33, 32).alias("concat_atac_mean"))


@_query("SELECT vec_id, (i - 1)::INT AS pos, round(embedding[i]::DOUBLE, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def q_concat_embedding(spark, sf):
    d = _halves(spark, sf)
    return d.select("vec_id", F.posexplode(vectors.embedding("concat_cage_atac", d.columns)).alias("pos", "x")).select("vec_id", "pos", _r6("x").alias("x"))


@_query("SELECT vec_id, (i - 1)::INT AS pos, round(CASE WHEN i <= 16 THEN embedding[i]::DOUBLE + embedding[i + 16]::DOUBLE ELSE embedding[i + 16]::DOUBLE + embedding[i + 32]::DOUBLE END, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 33)) AS i FROM embeddings)")
def q_add_embedding(spark, sf):
    d = _halves(spark, sf)
    return d.select("vec_id", F.posexplode(vectors.embedding("add_cage_atac", d.columns)).alias("pos", "x")).select("vec_id", "pos", _r6("x").alias("x"))


@_query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def q_repeat_mean(spark, sf):
    return _t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), _r6(F.avg("value")).alias("mean"))


@_query("SELECT label, (i - 1)::INT AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i")
def q_vector_mean_by_label(spark, sf):
    return aggregates.vector_mean(_t(spark, sf, "embeddings"), ["label"], "embedding").select("label", "pos", _r6("mean").alias("mean"))


@_query("SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0")
def q_finite_vectors(spark, sf):
    odd = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x, i: F.when(i == 9, F.lit(float("inf"))).otherwise(x)))
    e = _t(spark, sf, "embeddings").select("vec_id", F.coalesce(odd, F.col("embedding")).alias("v"))
    return e.where(vectors.all_finite(F.col("v"))).select("vec_id")


@_query("SELECT vec_id, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 6) AS z0 FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)")
def q_standardize(spark, sf):
    d = _t(spark, sf, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("z0"), F.lit(1.0).alias("constant"))
    return aggregates.standardized(d, ["z0", "constant"]).select("vec_id", _r6("z0").alias("z0"))


@_query("SELECT round(sum(z * z), 6) AS inertia, count(DISTINCT i) AS features FROM (SELECT i, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM (SELECT i, embedding[i]::DOUBLE AS x FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings)) WINDOW w AS (PARTITION BY i))")
def q_total_inertia(spark, sf):
    cols = [f"x{i}" for i in range(64)]
    d = aggregates.standardized(_t(spark, sf, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)]), cols)
    return d.agg(_r6(sum((F.sum(F.col(c) * F.col(c)) for c in d.columns), F.lit(0.0))).alias("inertia"), F.lit(len(d.columns)).cast("long").alias("features"))


@_query("SELECT (a.i - 1)::INT AS i, (b.i - 1)::INT AS j, round(sum(a.x * b.x), 6) AS value FROM (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)) a JOIN (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)) b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2")
def q_gram_entries(spark, sf):
    return aggregates.gram(_t(spark, sf, "embeddings"), "embedding").select("i", "j", _r6("value").alias("value"))


# Sequences


@_query("SELECT source, max(length(text))::INT AS longest, least((ceil(max(length(text)) / 256.0) * 256)::BIGINT, 524288) AS pad, (CASE WHEN pad <= 8192 THEN 32 WHEN pad <= 25344 THEN 16 WHEN pad <= 51712 THEN 8 WHEN pad <= 124672 THEN 4 WHEN pad <= 197888 THEN 2 WHEN pad >= 300000 THEN 1 ELSE 2 END)::INT AS batch FROM documents GROUP BY source")
def q_seq_length_bucket(spark, sf):
    d = _t(spark, sf, "documents").groupBy("source").agg(aggregates.longest(F.col("text")).alias("longest"))
    pad = sequence.padding_length(F.col("longest"))
    return d.select("source", "longest", pad.alias("pad"), sequence.batch_size(pad).alias("batch"))


_VOCAB_SQL = "['A','T','C','G','a','t','c','g','B','D','E','F','H','I','J','K','L','M','N','O','P','Q','R','S','U','V','W','X','Y','Z','b','d','e','f','h','i','j','k','l','m','n','o','p','q','r','s','u','v','w','x','y','z','-','@','#','|','_',' ',';']"
_IDS_SQL = f"SELECT p_partkey, i, CASE WHEN i > length(p_type) THEN 0 ELSE coalesce(nullif(list_position({_VOCAB_SQL}, substr(p_type, i, 1)), 0), 19) END AS id FROM (SELECT p_partkey, p_type, unnest(range(1, 33)) AS i FROM part)"


def _ids(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", sequence.token_ids(F.col("p_type"), pad_to=32, max_length=32).alias("ids"))


@_query(f"SELECT p_partkey, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids FROM ({_IDS_SQL}) GROUP BY p_partkey")
def q_tokenize(spark, sf):
    return _ids(spark, sf).select("p_partkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@_query(f"SELECT p_partkey, string_agg((CASE id WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 3 WHEN 8 THEN 4 WHEN 41 THEN 19 ELSE id END)::VARCHAR, ',' ORDER BY i) AS ids FROM ({_IDS_SQL}) GROUP BY p_partkey")
def q_upper_ids(spark, sf):
    return _ids(spark, sf).select("p_partkey", F.array_join(F.transform(sequence.upper_ids(F.col("ids")), lambda x: x.cast("string")), ",").alias("ids"))


@_query("SELECT p_partkey, greatest(0, 32 - length(p_type) - 2)::INT AS n_pad, 2 AS n_special, least(32 - 2, length(p_type))::INT AS n_valid FROM part")
def q_masks(spark, sf):
    ids = sequence.token_ids(F.col("p_type"), pad_to=32, max_length=32, ends=True)
    d = _t(spark, sf, "part").select("p_partkey", ids.alias("ids"))
    total = lambda m: F.aggregate(m, F.lit(0), lambda a, b: a + b)
    return d.select("p_partkey", total(sequence.padding_mask(F.col("ids"))).alias("n_pad"), total(sequence.special_mask(F.col("ids"))).alias("n_special"), total(sequence.valid_mask(F.col("ids"))).alias("n_valid"))


@_query("SELECT doc_id, length(text) AS n, CASE WHEN (ceil(greatest(length(text) * 20, 256) / 128.0) * 128)::BIGINT <= 128000 THEN (ceil(greatest(length(text) * 20, 256) / 128.0) * 128)::BIGINT END AS padded, CASE WHEN (ceil(greatest(length(text) * 20, 256) / 128.0) * 128)::BIGINT <= 128000 THEN 'ok' ELSE 'too_long' END AS status FROM documents")
def q_pad_to_multiple(spark, sf):
    n = F.length("text").cast("long")
    d = _t(spark, sf, "documents").select("doc_id", n.alias("n"), sequence.model_length(n * 20).alias("padded"))
    return d.withColumn("status", F.when(F.col("padded").isNotNull(), "ok").otherwise("too_long"))


@_query(f"SELECT p_partkey, coalesce(nullif(list_position({_VOCAB_SQL}, substr(p_name, 1, 1)), 0), 53)::INT AS id FROM part")
def q_token_lookup(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", sequence.token_id(F.substring("p_name", 1, 1)).alias("id"))


@_query("SELECT p_partkey, len(list_filter(regexp_split_to_array(replace(p_type, ' ', ' | '), '\\s+'), lambda x: x <> ''))::INT AS n FROM part")
def q_split_tokens(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.size(sequence.split_tokens(F.replace("p_type", F.lit(" "), F.lit("|")))).alias("n"))


@_query()
def q_mask_rate(spark, sf):
    ids = sequence.masked_ids(F.col("ids"), 0.25)
    return _ids(spark, sf).select("p_partkey", F.size(F.filter(ids, lambda x: x == sequence.MASK)).alias("n_masked"))


@_query(f"SELECT p_partkey, round(sum(CASE WHEN id <> 0 THEN (id * 3) % 7 ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN id <> 0 THEN 1 ELSE 0 END), 1e-8), 6) AS mean FROM ({_IDS_SQL}) GROUP BY p_partkey")
def q_masked_mean_pool(spark, sf):
    values = F.transform("ids", lambda x: ((x * 3) % 7).cast("double"))
    mask = F.transform(sequence.valid_mask(F.col("ids")), lambda x: x.cast("double"))
    return _ids(spark, sf).select("p_partkey", _r6(vectors.masked_mean(values, mask)).alias("mean"))


@_query(f"SELECT p_partkey, round(avg((id * 3) % 7), 6) AS mean FROM ({_IDS_SQL}) WHERE i <= 16 GROUP BY p_partkey")
def q_tss_prefix_mean(spark, sf):
    values = F.transform("ids", lambda x: ((x * 3) % 7).cast("double"))
    return _ids(spark, sf).select("p_partkey", _r6(vectors.prefix_mean(values, 16)).alias("mean"))


@_query(f"WITH m AS (SELECT p_partkey, sum(CASE WHEN id <> 0 THEN (id * 3) % 7 ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN id <> 0 THEN 1 ELSE 0 END), 1e-8) AS body, avg((id * 3) % 7) FILTER (i <= 16) AS head FROM ({_IDS_SQL}) GROUP BY p_partkey) SELECT p_partkey, 0 AS pos, round(body, 6) AS x FROM m UNION ALL SELECT p_partkey, 1, round(head, 6) FROM m")
def q_hap_concat(spark, sf):
    values = F.transform("ids", lambda x: ((x * 3) % 7).cast("double"))
    mask = F.transform(sequence.valid_mask(F.col("ids")), lambda x: x.cast("double"))
    both = F.concat(F.array(vectors.masked_mean(values, mask)), F.array(vectors.prefix_mean(values, 16)))
    return _ids(spark, sf).select("p_partkey", F.posexplode(both).alias("pos", "x")).select("p_partkey", "pos", _r6("x").alias("x"))


@_query(f"""WITH h AS (SELECT p_partkey, p_brand, 1 AS hap, p_type AS s FROM part UNION ALL SELECT p_partkey, p_brand, 2, p_name FROM part),
i AS (SELECT p_partkey, p_brand, hap, length(s) AS n, coalesce(nullif(list_position({_VOCAB_SQL}, ch), 0), 19) AS id FROM (SELECT *, unnest(string_split(s, '')) AS ch FROM h)),
t AS (SELECT name, k, unnest(range(width)) AS c, width FROM (VALUES ('cage', 2, 0), ('dnase', 1, 1), ('atac', 1, 2), ('rna_seq', 3, 3)) v(name, width, k)),
m AS (SELECT p_partkey, p_brand, hap, name, width, c, sum((id * (c + 1) + k) % 7) AS total, max(n) AS n, max(k) AS k FROM i, t GROUP BY ALL),
v AS (SELECT p_partkey, p_brand, name, max(width) * 2 AS width, sum(total / n) AS body, sum((total + (256 - n) * (k % 7)) / 256) AS head FROM m GROUP BY ALL)
SELECT p_brand AS gene_id, p_partkey::VARCHAR AS subject, 'concat_' || name || '_mean' AS field, width::INT AS width, round(body, 6) AS total, 'ok' AS status FROM v
UNION ALL SELECT p_brand, p_partkey::VARCHAR, 'concat_' || name || '_tss500_mean', width::INT, round(head, 6), 'ok' FROM v""")
def q_extract_embeddings(spark, sf):
    """Sequences through the stub model to pooled vectors of both haplotypes, one Arrow pass; the SQL is the stub's arithmetic."""
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("gene_id"), F.col("p_partkey").cast("string").alias("participant_id"), F.col("p_type").alias("ref_seq"), F.col("p_type").alias("mutation_seq_1"), F.col("p_name").alias("mutation_seq_2"))
    out = extract.embed(tables.sequences(p))
    return out.select("gene_id", "subject", "field", F.size("vector").alias("width"), _r6(F.aggregate("vector", F.lit(0.0), lambda a, b: a + b)).alias("total"), "status")


# Tests


def _labelled(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return _t(spark, sf, "embeddings").select("label", *[F.get(v, F.lit(i)).alias(f"x{i}") for i in range(4)])


@_query("WITH e AS (SELECT label, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS x FROM embeddings), r AS (SELECT label, count(*) AS n, regr_r2(y, x) AS r2 FROM e GROUP BY label) SELECT label, n, round(r2 / ((1 - r2) / (n - 2)), 6) AS f, n - 2 AS df2 FROM r")
def q_f_one_covariate(spark, sf):
    r = _labelled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.regr_r2("x0", "x1").alias("r2"))
    return r.select("label", "n", _r6(fdr.partial_f_from_r2(F.col("r2"), F.lit(0.0), 1, F.col("n") - 2)).alias("f"), (F.col("n") - 2).alias("df2"))


@_query()
def q_partial_f_1cov(spark, sf):
    """F of one feature per label, its tail by a vectorised function, and q-values over the labels."""
    @F.pandas_udf("double")
    def tail(f: pd.Series, df2: pd.Series) -> pd.Series:
        return pd.Series([tails.f_sf(a, 1, b) if b > 0 else float("nan") for a, b in zip(f, df2)])

    tests = q_f_one_covariate(spark, sf).withColumn("p_F", tail("f", "df2"))
    tests = tests.withColumns({c: F.lit("x1") for c in fdr.CONFIG})
    return fdr.with_q_values(tests, ["p_F"]).select("label", "n", "f", "df2", "p_F", "q_F_bh")


@_query("""WITH e AS (SELECT label, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS a, embedding[3]::DOUBLE AS b FROM embeddings),
r AS (SELECT label, count(*) AS n, corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab FROM e GROUP BY label),
s AS (SELECT *, (ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab) AS r2 FROM r)
SELECT label, n, round((r2 - ya * ya) / ((1 - r2) / (n - 3)), 6) AS f FROM s""")
def q_partial_f_2cov(spark, sf):
    r = _labelled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.corr("x0", "x1").alias("ya"), F.corr("x0", "x2").alias("yb"), F.corr("x1", "x2").alias("ab"))
    ya, yb, ab = F.col("ya"), F.col("yb"), F.col("ab")
    r2 = (ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab)
    return r.select("label", "n", _r6(fdr.partial_f_from_r2(r2, ya * ya, 1, F.col("n") - 3)).alias("f"))


def _association_inputs(spark, sf):
    e = _t(spark, sf, "embeddings")
    features = e.select((F.col("label") % 5).cast("string").alias("gene_id"), F.lit("stored").alias("embed_type"), F.col("vec_id").alias("participant_id"), F.col("embedding").cast("array<double>").alias("vector"))
    people = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("participant_id"), F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("age"))
    return features, people


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@_query()
def q_partial_f_pca(spark, sf):
    features, people = _association_inputs(spark, sf)
    quantity = people.select("participant_id", F.col("age").alias("label"), (F.col("participant_id") % 2).cast("double").alias("age"))
    return _rounded(grouped.associate(features, quantity, [models.parse_setting("variance:0.9"), models.parse_setting("fixed:5")], ("F",), ["age"], trait="n_chars"))


@_query()
def q_lrt_pca(spark, sf):
    features, people = _association_inputs(spark, sf)
    return _rounded(grouped.associate(features, people, [models.parse_setting("fixed:3")], ("F", "LRT"), ["age"], trait="quality"))


@_query()
def q_cell_pca(spark, sf):
    """With components of a second vector per participant in the smaller model."""
    features, people = _association_inputs(spark, sf)
    cell = tables.cell_vectors(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("participant_id"), F.slice("embedding", 1, 6).alias("cell_embedding")))
    return _rounded(grouped.associate(features, people, [models.parse_setting("fixed:4")], ("F",), ["age"], cell, [None, models.parse_setting("fixed:2")], trait="quality"))


@_query("SELECT lang, count(*) AS n, round(sum(toxic) * ln(avg(toxic)) + (count(*) - sum(toxic)) * ln(1 - avg(toxic)), 6) AS loglik FROM labels JOIN documents USING (doc_id) GROUP BY lang HAVING avg(toxic) > 0 AND avg(toxic) < 1")
def q_lrt_intercept_only(spark, sf):
    d = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    p = F.col("k") / F.col("n")
    return d.where("k > 0 AND k < n").select("lang", "n", _r6(F.col("k") * F.log(p) + (F.col("n") - F.col("k")) * F.log(1 - p)).alias("loglik"))


# q-values, selection, replication

_PSEUDO = "SELECT l_orderkey, l_linenumber, l_returnflag AS embed_type, l_linestatus AS gene_pca_id, 'none' AS cell_pca_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_discount + l_tax + 0.001) * (l_quantity / 50.0) * (1 + l_orderkey % 97) / 100.0 END AS p_F, l_partkey FROM lineitem"


def _pseudo(spark, sf):
    p = (F.col("l_discount") + F.col("l_tax") + 0.001) * (F.col("l_quantity") / 50.0) * (1 + F.col("l_orderkey") % 97) / 100.0
    p = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(p)
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("embed_type"), F.col("l_linestatus").alias("gene_pca_id"), F.lit("none").alias("cell_pca_id"), p.alias("p_F"), "l_partkey")


@_query(f"""WITH r AS (SELECT *, row_number() OVER w AS k, count(p_F) OVER (PARTITION BY embed_type, gene_pca_id, cell_pca_id) AS m FROM ({_PSEUDO}) WINDOW w AS (PARTITION BY embed_type, gene_pca_id, cell_pca_id ORDER BY p_F NULLS LAST))
SELECT l_orderkey, l_linenumber, CASE WHEN p_F IS NOT NULL THEN round(least(1.0, min(p_F * m / k) OVER (PARTITION BY embed_type, gene_pca_id, cell_pca_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) END AS q_F_bh FROM r""")
def q_bh_fdr(spark, sf):
    return fdr.with_q_values(_pseudo(spark, sf), ["p_F", "p_LRT"]).select("l_orderkey", "l_linenumber", _r6("q_F_bh").alias("q_F_bh"))


@_query(f"SELECT embed_type, l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY embed_type, l_partkey ORDER BY p_F, l_orderkey, l_linenumber) AS n FROM ({_PSEUDO}) WHERE p_F < 0.0005) WHERE n = 1")
def q_significant_genes(spark, sf):
    return fdr.significant(_pseudo(spark, sf), ["embed_type", "l_partkey"], level=0.0005, ties=("l_orderkey", "l_linenumber")).select("embed_type", "l_partkey", "l_orderkey", "l_linenumber")


def _list(spark, sf, flag):
    return _t(spark, sf, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 45)).select(F.col("l_partkey").alias("gene_id"))


_LIST = "SELECT l_partkey AS gene_id FROM lineitem WHERE l_returnflag = '{}' AND l_quantity > 45"


@_query(f"{_LIST.format('A')} UNION {_LIST.format('R')} UNION {_LIST.format('N')}")
def q_list_union(spark, sf):
    return _list(spark, sf, "A").union(_list(spark, sf, "R")).union(_list(spark, sf, "N")).distinct()


@_query(f"{_LIST.format('A')} INTERSECT {_LIST.format('R')}")
def q_list_intersect(spark, sf):
    return _list(spark, sf, "A").intersect(_list(spark, sf, "R"))


@_query(f"{_LIST.format('A')} EXCEPT {_LIST.format('R')}")
def q_list_except(spark, sf):
    return _list(spark, sf, "A").distinct().join(_list(spark, sf, "R"), "gene_id", "left_anti")


_COMPARED = "SELECT trait, gene_id, max(CASE WHEN b.g IS NULL THEN 0 ELSE 1 END) AS rec FROM (SELECT DISTINCT l_returnflag AS trait, l_partkey AS gene_id FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 48) a LEFT JOIN (SELECT DISTINCT l_returnflag AS t, l_partkey AS g FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 30) b ON trait = t AND gene_id = g GROUP BY ALL"


def _compared(spark, sf):
    l = _t(spark, sf, "lineitem").withColumnsRenamed({"l_returnflag": "trait", "l_partkey": "gene_id"})
    first = l.where("l_linestatus = 'F' AND l_quantity > 48").select("trait", "gene_id").distinct()
    return l.select("trait").distinct(), fdr.recovery(first, l.where("l_linestatus = 'O' AND l_quantity > 30"), ["trait"], "gene_id")


@_query(f"SELECT trait, gene_id, rec = 1 AS recovered FROM ({_COMPARED})")
def q_recovered(spark, sf):
    return _compared(spark, sf)[1].select("trait", "gene_id", "recovered")


@_query(f"SELECT t.trait, count(gene_id) AS n, coalesce(sum(rec), 0)::BIGINT AS n_recovered, round(avg(rec), 6) AS rate FROM (SELECT DISTINCT l_returnflag AS trait FROM lineitem) t LEFT JOIN ({_COMPARED}) c ON t.trait = c.trait GROUP BY t.trait")
def q_recovery_rate(spark, sf):
    return fdr.recovery_rate(*_compared(spark, sf), ["trait"]).withColumn("rate", _r6("rate"))


@_query("SELECT l_returnflag AS embed_type, count(*) FILTER (l_linenumber <= 4) AS n_ok, count(*) AS n, round(min(l_discount + l_tax), 6) AS least_p FROM lineitem GROUP BY 1")
def q_result_summary(spark, sf):
    l = _t(spark, sf, "lineitem")
    return l.groupBy(F.col("l_returnflag").alias("embed_type")).agg(F.count_if(F.col("l_linenumber") <= 4).alias("n_ok"), F.count(F.lit(1)).alias("n"), _r6(F.min(F.col("l_discount") + F.col("l_tax"))).alias("least_p"))


# Life of a run


@_query("SELECT p_partkey AS gene_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def q_missing_genes(spark, sf):
    genes = _t(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"))
    results = _t(spark, sf, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("gene_id")).agg(F.min("l_tax").alias("p_F"))
    results = results.withColumns({c: F.lit("x") for c in grouped.KEYS[1:]})
    return lifecycle.merged(results, genes, partial=True)[1]


@_query("SELECT p_partkey AS gene_id FROM part WHERE p_partkey % 3 = 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)")
def q_resume_pending(spark, sf):
    genes = _t(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"))
    done = _t(spark, sf, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("gene_id"))
    return lifecycle.pending(cohort.shard(genes, 1, 3, "gene_id"), done)


@_query("SELECT c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS status FROM customer UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders")
def q_ragged_union(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), allowMissingColumns=True)


@_query("SELECT user_id, date_trunc('hour', ts) AS start, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def q_windowed_means(spark, sf):
    return samples.windowed_means(_t(spark, sf, "events")).withColumn("mean", _r6("mean"))


@_query("SELECT p_brand, first(p_partkey ORDER BY p_retailprice DESC, p_partkey) AS best FROM part GROUP BY p_brand")
def q_top_per_group(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return _t(spark, sf, "part").withColumn("n", F.row_number().over(w)).where("n = 1").select("p_brand", F.col("p_partkey").alias("best"))


# Tails and tests in closed form: even numerator degrees, full spans and two-level designs have one in SQL


def _tail(function):
    @F.pandas_udf("double")
    def tail(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*x) for x in zip(*columns)], dtype="float64")

    return tail


@_query("""WITH t AS (SELECT p_partkey, (p_partkey % 23 + 1) / 4.0 AS f, 2 * (1 + p_partkey % 3) AS df1, 5 + p_partkey % 400 AS df2 FROM part),
x AS (SELECT *, df2 / (df2 + df1 * f) AS x, df2 / 2.0 AS a FROM t)
SELECT p_partkey, round(log10(pow(x, a) * CASE df1 WHEN 2 THEN 1 WHEN 4 THEN 1 + a * (1 - x) ELSE 1 + a * (1 - x) + a * (a + 1) / 2 * (1 - x) * (1 - x) END), 6) AS log_p FROM x""")
def q_f_tail(spark, sf):
    k = F.col("p_partkey")
    t = _t(spark, sf, "part").select(k, ((k % 23 + 1) / 4.0).alias("f"), (2 * (1 + k % 3)).cast("double").alias("df1"), (5 + k % 400).cast("double").alias("df2"))
    return t.select(k, _r6(F.log10(_tail(tails.f_sf)("f", "df1", "df2"))).alias("log_p"))


@_query("""WITH t AS (SELECT p_partkey, (p_partkey % 997) / 8.0 AS h, 1 + p_partkey % 3 AS m FROM part)
SELECT p_partkey, round((-h + ln(CASE m WHEN 1 THEN 1 WHEN 2 THEN 1 + h ELSE 1 + h + h * h / 2 END)) / ln(10), 6) AS log_p FROM t""")
def q_chi2_tail(spark, sf):
    k = F.col("p_partkey")
    t = _t(spark, sf, "part").select(k, ((k % 997) / 4.0).alias("x"), (2 * (1 + k % 3)).cast("double").alias("df"))
    return t.select(k, _r6(F.log10(_tail(tails.chi2_sf)("x", "df"))).alias("log_p"))


@_query("SELECT p_partkey, round((1 + p_partkey % 499) / 1000.0, 9) AS p FROM part")
def q_normal_tail(spark, sf):
    """z of p, and p again as half the chi-squared tail of z squared."""
    p = (1 + F.col("p_partkey") % 499) / 1000.0
    z = _t(spark, sf, "part").select("p_partkey", _tail(tails.normal_isf)(p).alias("z"), F.lit(1.0).alias("one"))
    return z.select("p_partkey", F.round(_tail(tails.chi2_sf)(F.col("z") * F.col("z"), F.col("one")) / 2, 9).alias("p"))


def _two_features(spark, sf):
    """Five genes of two features; a cohort with a quantity, a three-level covariate and a binary label."""
    e = _t(spark, sf, "embeddings")
    v = F.slice("embedding", 1, 2).cast("array<double>")
    features = e.select((F.col("label") % 5).cast("string").alias("gene_id"), F.lit("stored").alias("embed_type"), F.col("vec_id").alias("participant_id"), v.alias("vector"))
    people = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return features, people.select(F.col("doc_id").alias("participant_id"), F.col("n_chars").cast("double").alias("label"), (F.col("doc_id") % 3).cast("double").alias("age"))


#: Rows (g, id, y, a, x, z) of the cohort: the quantity, the covariate, the two features.
_TWO = "SELECT (label % 5)::VARCHAR AS g, vec_id AS id, n_chars::DOUBLE AS y, {a} AS a, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS z FROM embeddings JOIN labels ON vec_id = labels.doc_id JOIN documents ON vec_id = documents.doc_id"
#: What is left of y, x and z beside the covariate, by group.
_LEFT = "SELECT *, y - regr_slope(y, a) OVER w * a AS ry, x - regr_slope(x, a) OVER w * a AS rx, z - regr_slope(z, a) OVER w * a AS rz FROM e WINDOW w AS (PARTITION BY g)"
_PARTIAL = "SELECT g, count(*) AS n, coalesce(regr_r2(y, a), 0) AS red, corr(ry, rx) AS c1, corr(ry, rz) AS c2, corr(rx, rz) AS c12 FROM r GROUP BY g"


@_query(f"""WITH e AS ({_TWO.format(a='(vec_id % 3)::DOUBLE')}), r AS ({_LEFT}), c AS ({_PARTIAL}),
p AS (SELECT *, (c1 * c1 + c2 * c2 - 2 * c1 * c2 * c12) / (1 - c12 * c12) AS pr FROM c),
d AS (SELECT g, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS digest FROM e GROUP BY g),
two AS (SELECT g, 'fixed_2' AS setting, n, 2 AS k, 1.0 AS share, red, pr, 2 AS df1, n - 4 AS df2 FROM p),
s AS (SELECT *, sign(corr(x, z) OVER w) * (z - avg(z) OVER w) / stddev_samp(z) OVER w + (x - avg(x) OVER w) / stddev_samp(x) OVER w AS pc, abs(corr(x, z) OVER w) AS c FROM r WINDOW w AS (PARTITION BY g)),
s2 AS (SELECT *, pc - regr_slope(pc, a) OVER (PARTITION BY g) * a AS rp FROM s),
one AS (SELECT g, 'fixed_1' AS setting, count(*) AS n, 1 AS k, (1 + max(c)) / 2 AS share, regr_r2(y, a) AS red, pow(corr(ry, rp), 2) AS pr, 1 AS df1, count(*) - 3 AS df2 FROM s2 GROUP BY g),
vary AS (SELECT g, 'variance_0.53' AS setting, n, CASE WHEN one.share > 0.53 THEN 1 ELSE 2 END AS k, CASE WHEN one.share > 0.53 THEN one.share ELSE 1.0 END AS share, one.red, CASE WHEN one.share > 0.53 THEN one.pr ELSE two.pr END AS pr,
  CASE WHEN one.share > 0.53 THEN 1 ELSE 2 END AS df1, CASE WHEN one.share > 0.53 THEN one.df2 ELSE two.df2 END AS df2 FROM one JOIN two USING (g, n)),
a AS (SELECT * FROM two UNION ALL SELECT * FROM one UNION ALL SELECT * FROM vary)
SELECT g AS gene_id, 'stored' AS embed_type, setting AS gene_pca_id, 'none' AS cell_pca_id, 'dna_only' AS model, n AS n_samples, digest AS participant_ids_sha256, k::BIGINT AS gene_pca_components, 2::BIGINT AS gene_input_features, round(share, 6) AS gene_pca_explained_variance,
  round(pr / df1 / ((1 - pr) / df2), 6) AS "F_obs", CASE WHEN df1 = 2 THEN round(pow(1 - pr, df2 / 2.0), 6) END AS p_two, df1::BIGINT AS df1, df2::BIGINT AS df2, 2::BIGINT AS rank_red, (2 + df1)::BIGINT AS rank_full,
  round(red, 6) AS r2_red, round(1 - (1 - red) * (1 - pr), 6) AS r2_full, round((1 - red) * pr, 6) AS delta_r2, round(pr, 6) AS partial_r2, round(pr / (1 - pr), 6) AS cohen_f2, 'ok' AS status FROM a JOIN d USING (g)""")
def q_partial_f_components(spark, sf):
    """Partial F of principal components beside a covariate, by group: all ranks, shares and sizes of effect."""
    settings = [models.parse_setting(x) for x in ("fixed:2", "fixed:1", "variance:0.53")]
    rows = grouped.associate(*_two_features(spark, sf), settings, ("F",), ["age"], trait="n_chars")
    names = "gene_id embed_type gene_pca_id cell_pca_id model n_samples participant_ids_sha256 gene_pca_components gene_input_features gene_pca_explained_variance F_obs df1 df2 rank_red rank_full r2_red r2_full delta_r2 partial_r2 cohen_f2 status".split()
    return _rounded(rows.select(*names, F.when(F.col("df1") == 2, F.col("p_F")).alias("p_two")))


@_query(f"""WITH e AS ({_TWO.format(a="embedding[3]::DOUBLE")}), r AS ({_LEFT}), c AS ({_PARTIAL}),
plain AS (SELECT g, 'none' AS cell, 0 AS k, count(*) AS n, 0.0 AS red, (pow(corr(y, x), 2) + pow(corr(y, z), 2) - 2 * corr(y, x) * corr(y, z) * corr(x, z)) / (1 - pow(corr(x, z), 2)) AS pr, 1 AS rank FROM e GROUP BY g),
beside AS (SELECT g, 'fixed_1' AS cell, 1 AS k, n, red, (c1 * c1 + c2 * c2 - 2 * c1 * c2 * c12) / (1 - c12 * c12) AS pr, 2 AS rank FROM c)
SELECT g AS gene_id, cell AS cell_pca_id, CASE cell WHEN 'none' THEN 'dna_only' ELSE 'dna_cell' END AS model, k::BIGINT AS cell_pca_components, CASE k WHEN 1 THEN 1.0 END AS cell_pca_explained_variance, n AS n_samples,
  round(pr / 2 / ((1 - pr) / (n - rank - 2)), 6) AS "F_obs", round(pow(1 - pr, (n - rank - 2) / 2.0), 6) AS "p_F", rank::BIGINT AS rank_red, round(red, 6) AS r2_red, round(pr, 6) AS partial_r2 FROM (SELECT * FROM plain UNION ALL SELECT * FROM beside)""")
def q_cell_components(spark, sf):
    """With and without components of a second vector, the mean of two samples of each participant, in the smaller model."""
    features, people = _two_features(spark, sf)
    x = F.get("embedding", F.lit(2)).cast("double")
    samples_ = _t(spark, sf, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit("_a")).alias("subject_id"), F.explode(F.array(x - 1, x + 1)).alias("cell_embedding"))
    rows = grouped.associate(features, people, [models.parse_setting("fixed:2")], ("F",), (), tables.cell_vectors(samples_), [None, models.parse_setting("fixed:1")], trait="n_chars")
    return _rounded(rows.select("gene_id", "cell_pca_id", "model", "cell_pca_components", "cell_pca_explained_variance", "n_samples", "F_obs", "p_F", "rank_red", "r2_red", "partial_r2"))


_LEVELS = "SELECT (c_custkey % 3)::VARCHAR AS g, c_custkey % 4 AS lvl, count(*) AS n, count(*) FILTER (c_acctbal > 4000 + 300 * (c_custkey % 4)) AS k FROM customer GROUP BY 1, 2"


@_query(f"""WITH l AS ({_LEVELS}),
part AS (SELECT g, lvl = 0 AS zero, sum(n) AS n, sum(k) AS k FROM l GROUP BY 1, 2),
ll AS (SELECT g, sum(k * ln(k / n) + (n - k) * ln(1 - k / n)) AS whole, sum(n) AS n, sum(k) AS cases FROM l GROUP BY g),
lr AS (SELECT g, sum(k * ln(k / n) + (n - k) * ln(1 - k / n)) AS red FROM part GROUP BY g)
SELECT g AS gene_id, n::BIGINT AS n_samples, cases::BIGINT AS n_cases, 2::BIGINT AS df_lrt, round(2 * (whole - red), 6) AS "LRT_obs", round(exp(red - whole), 6) AS "p_LRT", round(red, 6) AS loglik_red, round(whole, 6) AS loglik_full,
  round(1 - whole / red, 6) AS mcfadden_r2_increment, true AS lrt_converged_red, true AS lrt_converged_full, 'ok' AS lrt_status, 'ok' AS status, NULL::DOUBLE AS "F_obs" FROM ll JOIN lr USING (g)""")
def q_lrt_levels(spark, sf):
    """Logistic likelihood ratio of two indicators beside another: both models fit the shares of their levels."""
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    is_ = lambda i: (k % 4 == i).cast("double")
    features = c.select((k % 3).cast("string").alias("gene_id"), F.lit("levels").alias("embed_type"), k.alias("participant_id"), F.array(is_(1), is_(2)).alias("vector"))
    people = c.select(k.alias("participant_id"), (F.col("c_acctbal") > 4000 + 300 * (k % 4)).cast("double").alias("label"), is_(0).alias("age"))
    rows = grouped.associate(features, people, [models.parse_setting("fixed:2")], ("LRT",), ["age"], trait="rich")
    names = "gene_id n_samples n_cases df_lrt LRT_obs p_LRT loglik_red loglik_full mcfadden_r2_increment lrt_converged_red lrt_converged_full lrt_status status F_obs".split()
    return _rounded(rows.select(*names))


@_query("""WITH o AS (SELECT ((o_custkey * 7 + o_orderkey) % 3001)::VARCHAR AS g, o_orderkey % 3 AS y FROM orders), c AS (SELECT g, count(*) AS n, min(y) = max(y) AS flat FROM o GROUP BY g)
SELECT g AS gene_id, CASE WHEN n < 3 THEN 'input_failed' WHEN g::INT % 5 = 0 THEN 'failed' WHEN flat THEN 'constant_outcome' ELSE 'ok' END AS status,
  CASE WHEN n < 3 THEN 'fewer than 3 participants' WHEN g::INT % 5 = 0 THEN 'no feature varies in the group' END AS error, CASE WHEN n >= 3 THEN n END AS n_samples, CASE WHEN n >= 3 AND g::INT % 5 <> 0 THEN 'not_binary' END AS lrt_status
FROM c""")
def q_group_status(spark, sf):
    """Groups that are too small, without a feature that varies, or with a constant label are rows with a status."""
    o = _t(spark, sf, "orders")
    gene = (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 3001
    x = F.when(gene % 5 == 0, F.lit(1.0)).otherwise(F.hash("o_orderkey").cast("double"))
    features = o.select(gene.cast("string").alias("gene_id"), F.lit("one").alias("embed_type"), F.col("o_orderkey").alias("participant_id"), F.array(x).alias("vector"))
    people = o.select(F.col("o_orderkey").alias("participant_id"), (2 + F.col("o_orderkey") % 3).cast("double").alias("label"))
    rows = grouped.associate(features, people, [models.parse_setting("fixed:1")], ("F", "LRT"), trait="third")
    return rows.select("gene_id", "status", "error", "n_samples", "lrt_status")


@_query("SELECT p_partkey, floor(length(p_partkey::VARCHAR) * 3 * 0.25)::INT AS n_masked FROM part")
def q_masked_bases(spark, sf):
    """Of sequences that hold bases only, the share is masked exactly, whatever the places."""
    text = F.translate(F.repeat(F.col("p_partkey").cast("string"), 3), "0123456789", "ATCGatcgAT")
    ids = sequence.masked_ids(sequence.token_ids(text, pad_to=32), 0.25)
    return _t(spark, sf, "part").select("p_partkey", F.size(F.filter(ids, lambda x: x == sequence.MASK)).alias("n_masked"))


@_query(f"SELECT p_partkey, (length(p_type) + length(p_brand) + 2)::INT AS n, length(p_type)::INT AS first, 2::BIGINT AS n_separators FROM part")
def q_paired_sequences(spark, sf):
    """Two sequences, each followed by a separator, and where these are."""
    ids = sequence.with_separator(sequence.token_ids(F.col("p_type")), 99, sequence.token_ids(F.col("p_brand")))
    mask = sequence.separator_mask(F.col("ids"), 99)
    return _t(spark, sf, "part").select("p_partkey", ids.alias("ids")).select("p_partkey", F.size("ids").alias("n"), (F.array_position(mask, 1) - 1).cast("int").alias("first"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_separators"))


# Files: written to the shared folder and read back


@_query("SELECT c_custkey AS participant_id, (c_nationkey % 2)::INT AS sex, c_acctbal AS label, c_nationkey::DOUBLE AS age FROM customer WHERE c_nationkey % 2 = 1 AND c_custkey % 9 <> 0")
def q_cohort_file(spark, sf):
    """One tab-separated file, written whole, read by its header as a cohort; blank cells are incomplete."""
    path = f"{sinks.scratch(spark, 'cohort')}/people.tsv"
    people = _cohort(spark, sf).withColumn("label", F.when(F.col("participant_id") % 9 != 0, F.col("label")))
    sinks.write_file(people.withColumn("unused", F.lit("x")), path, "participant_id")
    raw = tables.read_table(spark, path, [("participant_id", "long"), ("sex", "int"), ("label", "double"), ("age", "double")])
    return cohort.read_cohort(raw, "label", cohort.covariates(["age", "sex"], "label", "M"), "M").select("participant_id", "sex", "label", "age")


@_query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal, n_name AS gene_id FROM nation")
def q_id_file(spark, sf):
    """A list with a comment, a header, blanks and repeats."""
    names = [r[0] for r in _t(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()]
    path = f"{sinks.scratch(spark, 'ids')}/genes.tsv"
    sinks.write_text(spark, path, "# genes\nrank\tGene_ID\n\n" + "".join(f"{i}\t {n}  # note\n" for i, n in enumerate([*names, *names[:5]])))
    return tables.read_ids(spark, path)


@_query("SELECT n_regionkey::VARCHAR AS gene_id, n_nationkey, n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT '2', n_nationkey, 'again' FROM nation WHERE n_regionkey = 2")
def q_result_folder(spark, sf):
    """Results by gene, of which one is written again."""
    path = f"{sinks.scratch(spark, 'results')}/results"
    n = _t(spark, sf, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("gene_id"), "n_nationkey", "n_name")
    sinks.write_results(n, path)
    sinks.write_results(n.where("gene_id = 'g2'").withColumn("n_name", F.lit("again")), path, overwrite=True)
    return spark.read.parquet(path).select(F.substring("gene_id", 2, 9).alias("gene_id"), "n_nationkey", "n_name")


@_query("SELECT n_nationkey::VARCHAR AS gene_id, 2::BIGINT AS n FROM nation WHERE n_nationkey BETWEEN 10 AND 14")
def q_repeated_places(spark, sf):
    """Genes whose features lie in more than one file."""
    path = sinks.scratch(spark, "features")
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("gene_id"), "n_nationkey")
    for k, part in enumerate((n.where("n_nationkey < 15"), n.where("n_nationkey >= 10"))):
        part.coalesce(1).write.parquet(f"{path}/{k}")
    return tables.repeated_features(spark.read.parquet(f"{path}/0", f"{path}/1"))


@_query("SELECT r_regionkey::VARCHAR AS gene_id, n_nationkey::BIGINT AS participant_id, 'concat_cage_mean' AS field, n_nationkey * 0.5::DOUBLE AS x, n_nationkey + 1.0::DOUBLE AS y FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_matrix_files(spark, sf):
    """Files of matrices with an id field, without pickles; fields that are no matrix of numbers are left out."""
    path = sinks.scratch(spark, "matrices")
    by_region: dict[int, list[int]] = {}
    for r in _t(spark, sf, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect():
        by_region.setdefault(r[1], []).append(r[0])
    for region, keys in by_region.items():
        out = io.BytesIO()
        np.savez(out, subject_ids=np.array([f"{k}_s" for k in keys]), concat_cage_mean=np.array([[k * 0.5, k + 1.0] for k in keys]), names=np.array([["n"]] * len(keys)), short=np.zeros((len(keys) + 1, 2)))
        sinks.write_bytes(spark, f"{path}/{region}.npz", out.getvalue())
    rows = tables.read_npz(spark, path)
    return rows.select("gene_id", "participant_id", "field", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"))


@_query("SELECT CASE p_partkey % 2 WHEN 0 THEN 'Height' ELSE 'VAT' END AS trait, CASE p_partkey % 3 WHEN 0 THEN 'All' WHEN 1 THEN 'F' ELSE 'M' END AS stratum, p_partkey::VARCHAR AS gene_id, p_size::INT AS num_feature, round(p_retailprice, 6) AS \"F_obs\", round(1.0 / (1 + p_partkey), 6) AS \"p_F\" FROM part WHERE p_partkey < 400")
def q_list_files(spark, sf):
    """Result lists by trait and stratum, which the file names tell."""
    path, k = sinks.scratch(spark, "lists"), F.col("p_partkey")
    p = _t(spark, sf, "part").where("p_partkey < 400").select(k, k.cast("string").alias("gene_id"), F.col("p_size").alias("num_feature"), F.lit("concat_cage").alias("embed_type"), F.col("p_retailprice").alias("F_obs"), (1 / (1 + k)).alias("p_F"))
    for t, trait in enumerate(("Height", "VAT")):
        for s, suffix in enumerate(("", "_F", "_M")):
            sinks.write_file(p.where((k % 2 == t) & (k % 3 == s)).drop("p_partkey"), f"{path}/{trait}_extreme{suffix}.tsv", "gene_id")
    return tables.result_lists(spark, path).select("trait", "stratum", "gene_id", "num_feature", _r6("F_obs").alias("F_obs"), _r6("p_F").alias("p_F"))


def _outcome(call) -> str:
    try:
        return str(call())
    except ValueError:
        return "refused"


@_query("""SELECT * FROM (VALUES ('tests F', '(''F'',)'), ('tests f, lrt', '(''F'', ''LRT'')'), ('tests T', 'refused'), ('tests F,F', 'refused'), ('pca none', 'None'), ('pca variance:1', 'refused'), ('pca fixed:0', 'refused'),
('columns there', 'None'), ('column missing', 'refused'), ('file a/b c', 'a%2Fb%20c'), ('manifest new', 'None'), ('manifest same', 'None'), ('manifest changed', 'refused'), ('settings repeated', 'refused'), ('cell without vectors', 'refused'),
('dynamic 128000', 'ok'), ('dynamic 128001', 'too_long'), ('dynamic batch 33', 'too_many'), ('fixed 8192', 'ok'), ('fixed 8193', 'too_long'), ('no length', 'refused'), ('first key', 'participant_id'), ('no key', 'refused'), ('allow absent', 'refused')) t("case", outcome)""")
def q_refusals(spark, sf):
    """What settings, files and cohorts are taken, and what is refused."""
    path = f"{sinks.scratch(spark, 'manifest')}/run_manifest.json"
    features, people = _two_features(spark, sf)
    two, nation = [models.parse_setting("fixed:2")], _t(spark, sf, "nation")
    absent = spark.createDataFrame([(-1,)], "n_nationkey int").select(F.col("n_nationkey").cast(nation.schema["n_nationkey"].dataType).alias("n_nationkey"))
    cases = {
        "tests F": lambda: models.parse_tests("F"), "tests f, lrt": lambda: models.parse_tests("f, lrt"), "tests T": lambda: models.parse_tests("T"), "tests F,F": lambda: models.parse_tests("F,F"),
        "pca none": lambda: models.parse_setting("none"), "pca variance:1": lambda: models.parse_setting("variance:1"), "pca fixed:0": lambda: models.parse_setting("fixed:0"),
        "columns there": lambda: cohort.require(nation, ["n_name"]), "column missing": lambda: cohort.require(nation, ["n_name", "age"]), "file a/b c": lambda: sinks.file_name("a/b c"),
        "manifest new": lambda: sinks.write_manifest(spark, path, {"a": 1, "b": [2]}), "manifest same": lambda: sinks.write_manifest(spark, path, {"b": [2], "a": 1}), "manifest changed": lambda: sinks.write_manifest(spark, path, {"a": 2, "b": [2]}),
        "settings repeated": lambda: grouped.associate(features, people, two + two), "cell without vectors": lambda: grouped.associate(features, people, two, cell_settings=two),
        "dynamic 128000": lambda: extract.limits("m_dyn_a100.pt2").status(128_000), "dynamic 128001": lambda: extract.limits("m_dyn_a100.pt2").status(128_001), "dynamic batch 33": lambda: extract.limits("m_dyn_a100.pt2").status(256, 33),
        "fixed 8192": lambda: extract.limits("m_L8192_x").status(8192), "fixed 8193": lambda: extract.limits("m_L8192_x").status(8193), "no length": lambda: extract.limits("model"),
        "first key": lambda: tables.pick(["subject_id", "participant_id"], tables.EMBEDDING_KEYS), "no key": lambda: tables.pick(["name"], tables.EMBEDDING_KEYS), "allow absent": lambda: cohort.allow(nation, absent, "n_nationkey"),
    }
    return spark.createDataFrame([(k, _outcome(f)) for k, f in cases.items()], "case string, outcome string")



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
