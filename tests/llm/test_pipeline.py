"""The pipeline's stages against plain versions, and the registered queries."""

import random

import pytest

import brute
import corpus_pipeline
from strandex.llm import queries as llm_queries


def tables(spark, folder):
    rng = random.Random(11)
    sentence = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n)) + ". "
    texts = {i: "".join(sentence(rng.randrange(5, 12)) for _ in range(9)) for i in range(160)}
    passage = "".join(sentence(14) for _ in range(4))
    for i in range(100, 112):
        texts[i] += passage  # more than 50 words that repeat across documents
    texts[120] = texts[3]  # an exact copy
    item = sentence(25).strip()
    texts[130] += item
    for i in range(0, 160, 10):
        texts[i] = texts[i].replace("w1", "grumble w1").replace("w2", "grumble w2")
    texts |= {200: None, 201: "", 202: "tiny"}
    docs = [(i, t, "en", f"s{i % 4}", len(t) if t else 0) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i in range(160) if i not in (30, 41)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts, item


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    texts, item = tables(spark, folder)
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        out.append((docs.columns, {r.doc_id: r for r in docs.collect()}))
    return folder, texts, item, out


def test_each_stage_follows_its_plain_version(stages):
    _, texts, item, out = stages
    assert [tuple(c) for c, _ in out[:4]] == [corpus_pipeline.COLUMNS] * 4
    toxic, lines, distinct, clean, mixed = (rows for _, rows in out)
    assert set(texts) - set(toxic) == set(range(0, 160, 10))  # an unlabelled one too
    assert {i: r.text for i, r in toxic.items()} == {i: t for i, t in texts.items() if i in toxic}
    want = {i: x for i, x in brute.dedup_lines({i: r.text for i, r in toxic.items()}).items() if not (x[2] and not x[0].strip())}
    assert {i: r.text for i, r in lines.items()} == {i: x[0] for i, x in want.items()} and 120 not in lines
    assert all(r.n_chars == len(r.text or "") for r in lines.values())
    classes = brute.similar({i: r.text for i, r in lines.items()})
    assert set(distinct) == {i for i, (_, c) in classes.items() if c == i}
    leaks = brute.leaks({i: r.text for i, r in distinct.items()}, [(1, item)])
    assert set(clean) == {i for i, x in leaks.items() if not x[4]} and 130 not in clean
    size = {i: len((r.text or "").split()) for i, r in clean.items()}
    sums = {}
    for i, r in clean.items():
        sums[r.source] = sums.get(r.source, 0) + size[i]
    want = brute.targets(sums)
    assert all(r.target == pytest.approx(want[r.source]) and r.taken == r.copies * size[i] for i, r in mixed.items())
    taken = {s: sum(r.taken for r in mixed.values() if r.source == s) for s in sums}
    assert all(abs(taken[s] - want[s]) <= max(size.values()) for s in sums)


def test_run_equals_the_stages(spark, stages):
    folder, _, _, out = stages
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()} == out[-1][1]


def test_rows_without_an_id_and_repeated_rows(spark, stages, tmp_path):
    """A verdict holds for a text: rows without an id go by it too, and one row of a repeated one stays."""
    folder, texts, item, _ = stages
    rows = [(None, texts[10], "en", "s0", 1), (None, texts[11], "en", "s0", 1), (3, texts[3], "en", "s3", 1), (3, texts[3], "en", "s3", 1), (None, "clean " + item, "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(spark.read.parquet(f"{folder}/documents.parquet")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert sorted(r.text[:20] for r in kept.where("doc_id is null").collect()) == sorted([texts[11][:20], ("clean " + item)[:20]])
    assert kept.where("doc_id = 3").count() == 3
    assert corpus_pipeline.dedup_documents(spark, kept, folder).where("doc_id = 3").count() == 1
    assert [r.text for r in corpus_pipeline.drop_leaks(spark, kept, folder).where("doc_id is null").collect()] == [texts[11]]


def test_empty_tables(spark, stages, tmp_path):
    folder = stages[0]
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op4_line_dedup", "op5_mix_sources"])
def test_query_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = llm_queries.queries()[name](spark, sf)
    res = con.execute(llm_queries.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    key = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert key(df.collect()) == key([r[i] for i in at] for r in res.fetchall())


CONTRACT = {
    "op1_ngram_jaccard": "doc_id n_shingles component_id",
    "op2_url_filter": "page_id host path rule verdict",
    "op3_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op6_html_extraction": "page_id url text n_chars",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op8_embedding_dedup": "vec_id n_links component_id kept",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_language_id": "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_query_columns_and_rows(spark, sf, name):
    df = llm_queries.queries()[name](spark, sf)
    table = "pages" if "page_id" in CONTRACT[name] else "embeddings" if "vec_id" in CONTRACT[name] else "documents"
    assert set(CONTRACT[name].split()) <= set(df.columns) and df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_held_out_languages(spark, sf):
    got = llm_queries.op10_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0
