import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.functions import models, sequence, vectors
from strandex.operators import aggregates, cohort, extract, fdr, grouped
from strandex.plans import run as lifecycle
from strandex.sources import sinks, tables
from strandex.streaming import samples


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def q_plain(p):
    p = np.asarray(p, float)
    ok = np.isfinite(p)
    order = np.argsort(p[ok])
    q = np.minimum(1, np.minimum.accumulate((p[ok][order] * ok.sum() / np.arange(1, ok.sum() + 1))[::-1])[::-1])
    out = np.full(len(p), np.nan)
    back = np.empty(len(q))
    back[order] = q
    out[ok] = back
    return out


def test_q_values_match_the_step_up_rule(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.uniform(size=400), 2)
    p[::17] = np.nan
    p[5] = np.inf
    df = spark.createDataFrame([(i, float(x), "a", "b", "c") for i, x in enumerate(p)], "i int, p_F double, embed_type string, gene_pca_id string, cell_pca_id string")
    got = [r[0] for r in fdr.with_q_values(df, ["p_F", "p_LRT"]).orderBy("i").select("q_F_bh").collect()]
    want = q_plain(p)
    for a, b in zip(got, want):
        assert (a is None and math.isnan(b)) or a == pytest.approx(b, rel=1e-12)
    assert fdr.q_name("p_LRT") == "q_LRT_bh" and fdr.q_name("other") == "other_q_bh"


def test_selection_is_strict_and_recovery_of_an_empty_stratum_is_null(spark):
    df = spark.createDataFrame([("g", "a", 2.5e-6), ("h", "a", 1e-7), ("h", "b", 1e-9)], "gene_id string, embed_type string, p_F double")
    assert rows(fdr.significant(df, ["gene_id"])) == [("h", "b", 1e-9)]
    first = spark.createDataFrame([("t", "x"), ("t", "y")], "trait string, gene_id string")
    compared = fdr.recovery(first, first.where("gene_id = 'x'"), ["trait"], "gene_id")
    strata = spark.createDataFrame([("t",), ("u",)], "trait string")
    assert rows(fdr.recovery_rate(strata, compared, ["trait"]), "trait") == [("t", 2, 1, 0.5), ("u", 0, 0, None)]


def test_cohort_filters(spark):
    raw = spark.createDataFrame([("1", "0", "2.5", "30", "x"), ("2", "1", "NaN", "31", "x"), ("3", "2", "1", "32", "x"), ("4", "1", "1", "inf", "x"), ("5", "1", "7", "40", None)], "participant_id string, sex string, label string, age string, other string")
    assert rows(cohort.read_cohort(raw, "label", ["age", "sex"]), "participant_id") == [(1, 2.5, 0, 30.0), (5, 7.0, 1, 40.0)]
    assert rows(cohort.read_cohort(raw, "label", ["age", "sex"], "M").select("participant_id")) == [(5,)]
    with pytest.raises(ValueError, match="height"):
        cohort.read_cohort(raw, "label", ["height"])
    with pytest.raises(ValueError):
        cohort.covariates(["age", "age"], "label", "All")
    ids = spark.createDataFrame([(1,), (9,)], "participant_id long")
    with pytest.raises(ValueError, match="1 requested"):
        cohort.allow(cohort.read_cohort(raw, "label"), ids, "participant_id")


def test_ordinals_are_contiguous(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [r[0] for r in cohort.ordinals(df, ["k"]).orderBy("k").select("ordinal").collect()] == list(range(1000))


def test_identifier_list(spark, tmp_path):
    f = tmp_path / "genes.tsv"
    f.write_text("# list\nname\tGene\nx\t b # why\ny\ta\n\nz\tb\n")
    assert rows(tables.read_ids(spark, str(f)), "ordinal") == [(0, "b"), (1, "a")]
    f.write_text("q\nr\nq\n")
    assert rows(tables.read_ids(spark, str(f)), "ordinal") == [(0, "q"), (1, "r")]
    f.write_text("a/b\n")
    with pytest.raises(ValueError):
        tables.read_ids(spark, str(f))


def test_result_lists(spark, tmp_path):
    for name, p in (("Height_extreme", "1e-9"), ("Height_extreme_F", "1e-8")):
        (tmp_path / f"{name}.tsv").write_text(f"gene_id\tnum_feature\tembed_type\tF_obs\tp_F_analytic\nG\t50\tconcat_atac_pca50\t3.0\t{p}\n")
    got = rows(tables.result_lists(spark, str(tmp_path)).select("trait", "stratum", "p_F"), "stratum")
    assert got == [("Height", "All", 1e-9), ("Height", "F", 1e-8)]


def test_sequences_and_tokens(spark):
    df = spark.createDataFrame([("ATzé",), ("",)], "s string")
    assert [r[0] for r in df.select(sequence.token_ids(F.col("s"), pad_to=6)).collect()] == [[1, 2, 52, 19, 0, 0], [0] * 6]
    assert [r[0] for r in df.select(sequence.token_ids(F.col("s"), max_length=4, ends=True)).collect()] == [[61, 1, 2, 62], [61, 62]]
    assert df.select(sequence.token_id(F.lit("?"))).first()[0] == 53
    assert len(sequence.VOCABULARY) == 63 and sequence.IDS["-"] == 53 and sequence.IDS["[MASK]"] == 60
    t = spark.createDataFrame([(n,) for n in (2, 255, 256, 257, 128_000, 128_001)], "n long")
    assert [r[0] for r in t.select(sequence.model_length(F.col("n"))).collect()] == [256, 256, 256, 384, 128_000, None]
    assert [r[0] for r in t.select(sequence.padding_length(F.col("n"))).collect()] == [256, 256, 256, 512, 128_000, 128_256]


def test_masked_places_follow_the_order_of_their_hashes(spark):
    n, rate = 40, 0.3
    hashes = [r[0] for r in spark.range(n).select(F.xxhash64(F.lit("0"), F.col("id").cast("int"))).collect()]
    ids = ([1, 2, 19, 0, 8, None, 61, 7] * 5)[:n]
    places = sorted((i for i in range(n) if ids[i] not in (0, None)), key=hashes.__getitem__)
    chosen = set(places[: int(len(places) * rate)])
    want = [sequence.MASK if i in chosen and x in range(1, 9) else x for i, x in enumerate(ids)]
    df = spark.createDataFrame([(ids,), ([],), (None,), ([0, 0],)], "ids array<int>")
    assert [r[0] for r in df.select(sequence.masked_ids(F.col("ids"), rate)).collect()] == [want, [], None, [0, 0]]
    assert sequence.MASK in want


def test_masking_chooses_once_a_sequence(spark):
    """The choice doesn't come again for each base: 300,000 bases take seconds, not minutes."""
    text = F.repeat(F.lit("ATcg"), 250 + (F.col("id") % 2).cast("int"))
    ids = sequence.masked_ids(sequence.token_ids(text, pad_to=1100), 0.25)
    df = spark.range(0, 300, 1, 4).select("id", F.size(F.filter(ids, lambda x: x == sequence.MASK)).alias("n"))
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert rows(df, "id") == [(i, 250 + i % 2) for i in range(300)]
    finally:
        late.cancel()


def test_embedding_names_and_columns(spark):
    widths = {vectors.field(t, s): 4 for t in vectors.TRACKS for s in (False, True)}
    assert len(vectors.embedding_names(widths)) == 60
    names = vectors.embedding_names({"concat_cage_mean": 3, "concat_atac_mean": 2, "other": 5})
    assert names == ["concat_cage", "concat_atac", "add_atac", "concat_cage_atac", "other"]
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [5.0, 6.0])], "concat_cage_mean array<double>, concat_atac_mean array<double>")
    assert df.select(vectors.embedding("add_cage_atac", df.columns)).first()[0] == [4.0, 6.0, 11.0]
    assert df.select(vectors.embedding("concat_cage_atac", df.columns)).first()[0] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    with pytest.raises(ValueError):
        vectors.embedding("add_dnase", df.columns)


def test_extraction_agrees_with_column_pooling(spark):
    df = spark.createDataFrame([("g", "1", "ATCG" * 80, "ATCG" * 80, "AAT"), ("g", "2", "A", None, "C")], "gene_id string, subject string, ref_seq string, hap1 string, hap2 string")
    out = {(r.subject, r.field): r.vector for r in extract.embed(df).collect()}
    ids = sequence.token_ids(F.col("hap1"), pad_to=512)
    one = df.where("subject = '1'").select(ids.alias("ids"))
    value = F.transform("ids", lambda x: (x % 7).cast("double"))
    mask = F.transform(sequence.valid_mask(F.col("ids")), lambda x: x.cast("double"))
    body, head = one.select(vectors.masked_mean(value, mask), vectors.prefix_mean(value)).first()
    assert out["1", "concat_cage_mean"][0] == pytest.approx(body) and out["1", "concat_cage_tss500_mean"][0] == pytest.approx(head)
    assert out["2", "concat_cage_mean"][:2] == [0.0, 0.0]  # nothing but padding
    assert {r.status for r in extract.embed(df, package=extract.Limits(longest=256)).collect()} == {"too_long"}


def _inputs(spark, n=40):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 5))
    features = [(g, "e", i, (x[i] * k).tolist() if g != "flat" else [1.0] * 5) for k, g in ((1, "a"), (2, "b"), (1, "flat")) for i in range(n)] + [("few", "e", 0, [1.0] * 5)]
    people = [(i, float(x[i, 0] + rng.normal() > 0), float(i % 7)) for i in range(n)]
    return spark.createDataFrame(features, "gene_id string, embed_type string, participant_id long, vector array<double>"), spark.createDataFrame(people, "participant_id long, label double, age double")


def test_grouped_tests_give_rows_for_every_outcome(spark):
    features, people = _inputs(spark)
    out = grouped.associate(features, people, [models.parse_setting("fixed:2"), models.parse_setting("variance:0.9")], ("F", "LRT"), ["age"])
    got = {(r.gene_id, r.gene_pca_id): r for r in out.collect()}
    assert got["a", "fixed_2"].status == "ok" and got["a", "fixed_2"].lrt_status == "ok" and got["a", "fixed_2"].is_binary
    assert got["a", "fixed_2"].F_obs == pytest.approx(got["b", "fixed_2"].F_obs)  # scaled features span the same space
    assert got["flat", "fixed_2"].status == "failed" and got["few", "fixed_2"].status == "input_failed" and got["few", "fixed_2"].df1 is None
    assert len(got) == 8 and len({r.participant_ids_sha256 for r in got.values() if r.n_samples}) == 1


def test_run_resume_and_merge(spark, tmp_path):
    features, people = _inputs(spark)
    genes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "absent")], "ordinal long, gene_id string")
    out = f"file://{tmp_path}/run"
    lifecycle.run(spark, out, genes, features, people, ["fixed:2"], covariates=["age"], rank=0, world=2)
    with pytest.raises(ValueError, match="1 genes"):
        lifecycle.merge(spark, out, genes)
    lifecycle.run(spark, out, genes, features, people, ["fixed:2"], covariates=["age"], rank=1, world=2)
    lifecycle.run(spark, out, genes, features, people, ["fixed:2"], covariates=["age"], rank=1, world=2)  # nothing is left
    assert rows(spark.read.parquet(f"{out}/results").select("gene_id", "status"), "gene_id") == [("a", "ok"), ("absent", "input_failed"), ("b", "ok")]
    lifecycle.merge(spark, out, genes)
    with pytest.raises(ValueError, match="settings"):
        lifecycle.run(spark, out, genes, features, people, ["fixed:3"], covariates=["age"])
    assert sinks.file_name("a b/c") == "a%20b%2Fc"


def test_aggregates(spark):
    df = spark.createDataFrame([("p", [1.0, 2.0]), ("p", [3.0, 6.0]), ("q", [5.0, 1.0])], "k string, v array<double>")
    assert rows(aggregates.collected(aggregates.vector_mean(df, ["k"], "v"), ["k"]), "k") == [("p", [2.0, 4.0]), ("q", [5.0, 1.0])]
    got = {(r.i, r.j): r.value for r in aggregates.gram(df, "v", 2).collect()}
    assert got == {(0, 0): 35.0, (0, 1): 25.0, (1, 1): 41.0}


def test_gram_takes_its_width_from_the_data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 64))
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([1.0, None, 2.0],)], "v array<float>").repartition(3)
    got = {(r.i, r.j): r.value for r in aggregates.gram(df, "v").collect()}
    full = np.vstack([x.astype(np.float32), np.eye(64)[0] + 2 * np.eye(64)[2]]).astype(float)
    assert len(got) == 64 * 65 // 2 and all(abs(got[i, j] - (full.T @ full)[i, j]) < 1e-9 for i, j in got)


def test_streamed_means_equal_the_batch(spark, tmp_path):
    batch = spark.range(300).select((F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.col("id") * 120).alias("ts"), F.col("id").cast("double").alias("value"))
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([(0, 0.0)], "user_id long, value double").select("user_id", F.timestamp_seconds(F.lit(10_000_000)).alias("ts"), "value")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = samples.windowed_means(stream).writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    late.select("user_id", "ts", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # moves the watermark
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("means"), "user_id", "start") == rows(samples.windowed_means(batch), "user_id", "start")


def test_extract_command_and_npz(spark, tmp_path):
    df = spark.createDataFrame([("g", "1_x", "ATCG", "AT", "AC"), ("h", "2", "A", "A", "A")], "gene_id string, participant_id string, ref_seq string, mutated_seq_1 string, variant_seq string")
    df.write.parquet(f"{tmp_path}/seq")
    (tmp_path / "genes.tsv").write_text("gene_id\ng\nh\nabsent\n")
    for _ in range(2):  # the second time nothing is pending
        lifecycle.main(["extract", "--genes", str(tmp_path / "genes.tsv"), "--out", f"file://{tmp_path}/out", "--sequences", f"{tmp_path}/seq"])
    out = spark.read.parquet(f"{tmp_path}/out/embeddings")
    assert out.count() == 16 and {r.gene_id for r in out.collect()} == {"g", "h"}
    (tmp_path / "npz").mkdir()
    np.savez(tmp_path / "npz" / "g.npz", subject_ids=np.array(["7_a", "8_b"]), concat_cage_mean=np.ones((2, 4)), note=np.array(["x"]))
    got = tables.read_npz(spark, str(tmp_path / "npz"))
    assert rows(got, "participant_id") == [("g", 7, "concat_cage_mean", [1.0] * 4), ("g", 8, "concat_cage_mean", [1.0] * 4)]
    assert tables.repeated_features(out).count() == 0


def test_model_limits_and_separators(spark):
    assert extract.limits("x_dyn_a100.pt2") == extract.Limits() and extract.limits("m_L8192_b8.pt2").longest == 8192
    assert extract.Limits().status(128_001) == "too_long" and extract.Limits().status(1, 33) == "too_many"
    with pytest.raises(ValueError):
        extract.limits("m.pt2")
    one = spark.range(1).select(sequence.with_separator(F.array(F.lit(1)), 9, F.array(F.lit(2))).alias("i"))
    assert one.select("i", sequence.separator_mask(F.col("i"), 9)).first()[:] == ([1, 9, 2, 9], [0, 1, 0, 1])
