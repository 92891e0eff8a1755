import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from strandex.llm import decontam, embeddings, html, jaccard, language, linededup, mixing, tokens, toxicity, urls, wordhash
from strandex.llm.queries import URL_RULES
from strandex.llm.runtime import Tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    """Documents with columns whose names clash with what operators add."""
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or ""), 7, "x", 1.0) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS + ", size long, id string, score double")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies in chains, a passage shared by many, odd and very long texts."""
    rng = random.Random(7)
    texts, base, passage = {}, words(rng, 130), " ".join(words(rng, 60))
    for i in range(30):
        near = list(base)
        for _ in range(i % 6):
            near[rng.randrange(len(near))] = "changed%d" % rng.randrange(9)
        texts[i] = " ".join(near)
    for i in range(30, 60):
        texts[i] = " ".join(words(rng, 20 + i)) + ". " + passage + "\n" + " ".join(words(rng, 10))
    for i in range(60, 75):
        texts[i] = " ".join(words(rng, rng.randrange(1, 9), 6))
    texts |= {75: None, 76: "", 77: " \n\t ", 78: "one", 79: "ONE", 80: "a b c d e", 81: "A b\tc  d\ne", 82: " ".join(words(rng, 30_000)), 83: passage, 84: passage.upper(), 85: "\x01 . ! x"}
    texts[86] = texts[82] + " tail"
    return texts


def test_words_and_hashes_agree_with_patterns(corpus):
    texts = [*corpus.values(), "É é\x00a,B-c 日本語 naïve", "x" * 70_000]
    for separator, pattern in ((wordhash.WHITE, brute.WORDS), (wordhash.NOT_ALNUM, brute.LETTERS)):
        seen = {}
        for text, hashed in zip(texts, wordhash.documents(pa.array(texts), separator), strict=True):
            plain = pattern.findall(brute.lower(text))
            assert len(plain) == len(hashed)
            assert all(seen.setdefault(w, h) == h for w, h in zip(plain, hashed.tolist()))
        assert len(set(seen.values())) == len(seen)


def test_similar_sets(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_sets(frame(spark, corpus)).collect()}
    assert got == brute.similar(corpus)


def test_similar_sets_without_pivots_find_chains(spark):
    """Sets that link only over others, whatever set is the pivot."""
    rng = random.Random(1)
    texts, text = {}, words(rng, 100, 10**6)
    for i in range(24):
        texts[rng.randrange(10**6)] = " ".join(text)
        text = [*text[7:], *words(rng, 7, 10**6)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_sets(frame(spark, texts)).collect()}
    assert got == brute.similar(texts)


@pytest.mark.parametrize("tile", [jaccard.TILE, 1500])
def test_similar_sets_of_near_copies_without_their_original(spark, monkeypatch, tile):
    """Few of them link, and only with some: no pivot settles the group, whatever the size of the tiles."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(15)
    texts = {}
    for group, changes in enumerate((2, 2, 3)):
        base = words(rng, 120, 10**6)
        for i in range(40):
            near = list(base)
            for _ in range(changes):
                near[rng.randrange(len(near))] = f"new{rng.randrange(60)}"
            texts[1000 * group + 7 * i + 1] = " ".join(near)
    want = brute.similar(texts)
    assert 5 < len({c for _, c in want.values()}) < 115
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_sets(frame(spark, texts)).collect()} == want


def test_similar_sets_without_a_probability(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_sets(frame(spark, corpus), exact=True).collect()}
    assert got == brute.similar(corpus)


def test_overlaps_are_summed_over_the_fragments(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(4)]
    sets += [np.unique(np.concatenate([sets[0][::3], sets[1][::2]])), sets[2]]
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    for at_once in (1 << 20, 7):
        monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
        for x in sets:
            assert jaccard.overlaps(x, flat[order], rows, len(sets), 0).tolist() == [len(np.intersect1d(x, y)) for y in sets]
    assert jaccard.overlaps(sets[3], flat[order], rows, len(sets), 301).sum() == 0


def test_similar_sets_edges(spark):
    empty = jaccard.similar_sets(frame(spark, {}).where("false"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_sets(df).collect()), key=repr)
    assert got == sorted([(None, 1, None), (3, 1, 1), (3, 1, 1), (1, 1, 1), (None, 0, None)], key=repr)
    with pytest.raises(ValueError):
        jaccard.similar_sets(df, percent=50)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 3) for i in range(1, 57, 2)] + [(100, 101), (100, 102)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.v: r.c for r in jaccard.components(df, Tables(spark, "t"), "t").collect()}
    nodes = {x for l in links for x in l}
    assert got == brute.least_reachable(nodes, links)


def test_leaks(spark, corpus, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((40, 10, 9, 3, 1, 0, 25))] + [(7, None), (7, " ".join(corpus[30].split()[5:16])), (8, corpus[31].upper()), (9, "zz " * 30), (6, "w1 w2")]
    texts = dict(corpus) | {200: "before " + items[0][1] + ", after", 201: items[2][1], 202: "zz " * 50, 203: " ".join(items[0][1].split()[:9])}
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(texts, items)
    # Held whole; joined by broadcast and by shuffle, in blocks of a few items and of one, in groups of some texts and of one.
    for whole, part, group, marks in ((decontam.BLOCK_BYTES, 1, 1, 1), (0, 400, 32 << 20, 1 << 20), (0, 50, 300, 0)):
        for name, value in (("BLOCK_BYTES", whole), ("PART_BYTES", part), ("GROUP_BYTES", group), ("BROADCAST_MARKS", marks)):
            monkeypatch.setattr(decontam, name, value)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.find_leaks(frame(spark, texts), bench).collect()}
        assert got == want
    assert decontam.find_leaks(frame(spark, texts), bench.where("false")).where("contaminated").count() == 0
    assert decontam.find_leaks(frame(spark, texts).where("false"), bench).count() == 0


def test_leaks_joined_edges(spark, monkeypatch):
    """Null and repeated ids, repeated rows, one id on two texts, and a benchmark without words."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 0)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(None, passage), (None, "clean text"), (1, passage + " x"), (1, passage + " x"), (1, "clean"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), ("b", "...")], "item_id string, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontam.find_leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(None, 12, 12, 1), (None, 2, 0, 0), (1, 13, 12, 1), (1, 13, 12, 1), (1, 1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0)], key=repr)
    assert decontam.find_leaks(docs, bench.where("item_id = 'b'")).where("contaminated").count() == 0
    assert decontam.find_leaks(docs.where("false"), bench).count() == 0


def test_line_dedup(spark, corpus):
    rng = random.Random(5)
    line = lambda: " ".join(words(rng, 4)) + rng.choice(["\n", ". ", "! "])
    shared = [line() for _ in range(5)] + [" ".join(words(rng, 9)) + ", "]
    texts = dict(corpus)
    for i in range(300, 330):
        texts[i] = line() + "".join(shared[i % 3 : 3 + i % 4]) + line()
    texts |= {330: "a\n\n\n\n\n\nb", 331: "x\ny\nz\nx\ny\nz\nx\ny\nz", 332: "one\x01 two. three\nfour. five\n", 333: "one\x01 two. three\nfour. five\n", 334: "a, b, c, d, e", 335: "x a, b, c, d, e", 336: "é" * 70 + ", b, c, d.", 337: "é" * 70 + ", b, c, e."}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert got == brute.dedup_lines(texts)


def test_line_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in linededup.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(None, "a\nb\nc", 0), (1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "", 3)], key=repr)
    assert linededup.dedup_lines(df.where("false")).count() == 0


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5000, "c": 40, None: 900, "d": 7}, {"a": 3}, {"a": 0, "b": 0}, {"a": 10, "b": 10, "c": 10, "d": 10_000}, {None: 50, "": 60},
])
def test_mixing(spark, sizes):
    rng = random.Random(2)
    rows, k = [], 0
    for s, total in sizes.items():
        left = total
        while left > 0 or not any(r[2] == s for r in rows):
            n = min(left, rng.choice([0, 1, 3, 9]))
            rows.append((k, " ".join(["w"] * n) or None, s))
            left, k = left - n, k + 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 9 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(df.repartition(3)).collect()), key=repr)


def test_mixing_edges(spark):
    clash = spark.createDataFrame([(1, "a b", "x", 5, "y", 3, 2)], "doc_id long, text string, source string, copies int, bucket string, last_key int, size int")
    r = mixing.mix_sources(clash).first()
    assert (r.copies, r.bucket, r.last_key, r["size"], r.source_size) == (5, "y", 3, 2, 2)
    assert mixing.mix_sources(frame(spark, {}).where("false")).count() == 0
    df = spark.createDataFrame([(None, "a b", "x"), (None, "a b", "x"), (4, "c", "x")], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix_sources(df).where("doc_id is null").collect()} <= {2, 4}


def test_token_counts(spark, corpus):
    sentencepiece, P = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    texts = dict(corpus) | {300 + i: "".join(rng.choice("ab  ▁\né<s>日") for _ in range(rng.randrange(1, 60))) for i in range(300)}
    texts |= {700: "z" * 70_000, 701: " " * 66_000 + "q", 702: ("word " * 30_000).strip(), 703: "<s> </s> <unk> <0x0A>", 704: "a ", 705: " a"}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(frame(spark, texts), P.path("piece_bpe_32k.model")).collect()}
    assert got == {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in texts.items()}


def test_spliced_counts_are_the_library_s(monkeypatch):
    import public_tokenizers

    counter = tokens.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.provable
    rng = random.Random(21)
    odd = ["naïve", "日本語", "🙂🙂", "x" * 90, "\u2581a", "\t\n", "don't,", "<s>", "1234567", "ﬁ", "", ""]
    texts = [" ".join(rng.choice(odd + words(rng, 9)) for _ in range(n)) for n in (40, 300, 900)]
    texts += ["y" * 700, "🙂" * 300, " " * 500, " lead " * 90, ("z" * 130 + " ") * 9, "日本" * 200 + " end " + "q" * 400]
    want = [len(counter.model.encode(t)) for t in texts]
    seen, encode = [], counter.starts
    monkeypatch.setattr(counter, "starts", lambda text, at, end: seen.append(end - at) or encode(text, at, end))
    for chunk, overlap in ((64, 8), (200, 16)):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        monkeypatch.setattr(tokens, "OVERLAP", overlap)
        assert [counter.count(t) for t in texts] == want
    seen.clear()
    plain = " ".join(words(rng, 2000))
    assert counter.count(plain) == len(counter.model.encode(plain)) and max(seen) <= 200 and len(seen) > 40
    monkeypatch.setattr(counter, "starts", lambda text, at, end: encode(text, at, end)[encode(text, at, end) % 2 == 0])
    assert counter.count(plain) < len(counter.model.encode(plain))  # the chunks' own encodings make the count


@pytest.mark.parametrize("tile,leaves,numbers", [(8, 1024, 1 << 22), (8, 2, 128), (2048, 1024, 1 << 22)])
def test_near_vectors(spark, monkeypatch, tile, leaves, numbers):
    monkeypatch.setattr(embeddings, "LEAVES", leaves)  # leaves that are cut into pieces, and no vector that counts as common
    monkeypatch.setattr(embeddings, "NUMBERS", numbers)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    vectors = {i: (base[i % 12] + rng.normal(size=16) * 0.18).tolist() for i in range(90)}
    vectors |= {100: None, 101: [], 102: [0.0] * 16, 103: [float("nan")] + [1.0] * 15, 104: [None] + [1.0] * 15, 105: [float("inf")] * 16, 106: vectors[3], 107: vectors[3], 108: [2 * x for x in vectors[3]], 109: [1.0, 2.0], 110: [2.0, 4.0], 111: [1e200] * 16, 112: [1e-200] * 16, 113: [-1.0] * 16}
    rows = [(i, v, i % 3, "x") for i, v in vectors.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, weight string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df, tile=tile).collect()}
    want = brute.near({i: v if i not in (111, 112) else [1.0] * 16 for i, v in vectors.items()})
    assert got == want and sum(n for n, _ in want.values()) > 100


def test_near_vectors_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embeddings.near_vectors(df).collect()), key=repr)
    assert got == sorted([(None, 0, None, False), (5, 1, 5, True), (5, 1, 5, True), (7, 0, 7, True)], key=repr)
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_early_stop_loses_no_pair():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(80, 20)) * np.linspace(2, 0.1, 20)
    a /= np.linalg.norm(a, axis=1)[:, None]
    for t in (0.3, 0.8, 0.95):
        i, j = embeddings.linked(a, a, t, step=3)
        want = {(x, y) for x, y in zip(*np.nonzero(a @ a.T >= t))}
        assert want <= set(zip(i.tolist(), j.tolist()))


PAGES = {
    "": "",
    "<p>a &amp; b<p>c\n  d": "a & b\nc d",
    "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><article><h1>Head</h1><p>One, two. Three.</p><ul><li>x<li>y</ul><script>var p='</p>';</script></article><footer>F</footer></body></html>": "Head\nOne, two. Three.\nx\ny",
    "<div class='cookie-notice'><p>We use cookies, fine. Yes, all.</p></div><article><p>A, b.</p><section class=comments><p>No, never. Ever.</p></section></article>": "A, b.",
    "<body><div id=content><h1>T</h1><p>Long text here, with marks. And more.</p><p>x</p></div><div class=sidebar><p>Side, text.</p></div><form><p>f</p></form></body>": "T\nLong text here, with marks. And more.\nx",
    "<main><header><h1>Title</h1></header><article><p>Hello <b>wor</b>ld,&nbsp; it is.</p><article><p>A comment, here.</p></article></article></main>": "Hello world, it is.",
    "<nav><ul><li>only a menu</li></ul></nav>": "",
    # The ratios decide: no telling tag, name or role.
    "<body><div class=x1><a>Home</a> <a>News</a> <a>About us</a></div><div class=x2><h1>Head</h1><p>A first sentence, with more. And then a second one, too.</p><p>ok</p><p>The last one, it ends here. Or does it?</p></div><div class=x3><span>Top</span><span>Login</span></div></body>": "Head\nA first sentence, with more. And then a second one, too.\nok\nThe last one, it ends here. Or does it?",
    # Unlucky names in an article: they read like the rest.
    "<article><p>First, a sentence that is long. Yes.</p><p class='share-price'>The price, it rose by far. So they say.</p><div class='legal-history'><p>Then came the law, which was new. And so on.</p></div><div class='share'><a>Tweet</a></div></article>": "First, a sentence that is long. Yes.\nThe price, it rose by far. So they say.\nThen came the law, which was new. And so on.",
    # An article around articles is no comment on them.
    "<article><h1>T</h1><article><p>One part, of two. It is long enough.</p><p>Two, of two parts. It is as long.</p></article></article>": "T\nOne part, of two. It is long enough.\nTwo, of two parts. It is as long.",
    "<p>unclosed <b>bold<p>next <!-- no --> one": "unclosed bold\nnext one",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


def test_the_ratios_choose_the_content(monkeypatch):
    page = next(p for p in PAGES if "x2" in p)
    monkeypatch.setattr(html, "ratios", lambda found: {x[0]: float("a" in x[0]) for x in found})
    assert "Home" in html.main_text(page) and "Head" not in html.main_text(page)


def test_ratios_follow_the_definition():
    page = "<div><p>Ab, cd. Ef!</p><p>gh</p><h1>Title</h1><ul><li>x, y</li><li>z</li></ul></div>"
    got = html.ratios(list(html.nodes(page)))
    paths = {("div", "p"): (11 + 2, 3, 2), ("div", "h1"): (5, 0, 1), ("div", "ul", "li"): (4 + 1, 1, 2)}
    length, marks = [a / n for a, _, n in paths.values()], [(b + 0.1) / n for _, b, n in paths.values()]
    smooth = lambda v: [0.25 * v[max(0, i - 1)] + 0.5 * v[i] + 0.25 * v[min(len(v) - 1, i + 1)] for i in range(len(v))]
    fused = [max(a, b) * max(c, d) for a, b, c, d in zip(length, smooth(length), marks, smooth(marks))]
    assert got == pytest.approx({p: x / max(fused) for p, x in zip(paths, fused)})


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>é &lt; x</p>", "t"), (1, "u", "<p>q</p>" * 5000, "t")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.n_chars, len(r.text)) for r in html.extract(df).collect()), key=repr)
    assert got == sorted([(1, None, 0, 0), (None, "u", 5, 5), (1, "u", 9999, 9999)], key=repr)
    assert html.extract(df.where("false")).count() == 0


def test_url_rules_and_trees(spark):
    urls_ = ["http://Example.COM/en/7?x", "https://a.example.com/en/8", "http://notcom/en/1", "http://b.net/de/1#z", "http://example.net/de/80", "http://x.org/es/", "http://x.org/ES/", "no scheme", None, "", "http://", "ftp://com?/en/", "http://u.com:80/en/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls_)], "page_id long, url string, host string")
    out = {r.page_id: r for r in urls.judge(df, URL_RULES, urls.Trees()).collect()}
    assert [(out[i].rule, out[i].verdict) for i in range(7)] == [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]
    assert [(out[i].host, out[i].path) for i in (0, 3, 7, 8, 9, 10, 11, 12)] == [("example.com", "/en/7"), ("b.net", "/de/1"), ("", ""), ("", ""), ("", ""), ("", ""), ("com", ""), ("u.com:80", "/en/")]
    rng = random.Random(0)
    bad = [f"http://{''.join(rng.choice('0123456789ab') for _ in range(20))}.biz/p?a={i}&b=2&c=3" for i in range(150)]
    good = [f"https://site{rng.choice('abcdef')}.org/page/{rng.choice(['about', 'news', 'blog'])}" for _ in range(150)]
    labelled = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in good] + [(None, True), ("x", None)], "url string, block boolean")
    model = urls.fit_trees(labelled)
    judged = urls.judge(labelled.where("url is not null and block is not null"), (), model)
    assert judged.where("(verdict = 'block') <> block").count() <= 3
    again = urls.fit_trees(labelled.repartition(5))
    assert again.trees == model.trees and again.cuts == model.cuts
    assert judged.where("false").count() == 0 and "Python" not in judged._jdf.queryExecution().toString()


def test_trees_add_up_and_split_by_the_gain():
    """The first tree of the boosting against a plain search for the best split, and the margin as the sum of the leaves."""
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 4, (40, 3))
    n, y = rng.integers(1, 9, 40).astype(float), np.zeros(40)
    y[:] = np.where(cells[:, 1] > 1, n, 0) + np.where((cells[:, 1] <= 1) & (cells[:, 0] == 0), 1, 0)
    bias, trees = urls._boost(cells, n, y, [4, 4, 4])
    p = np.full(40, 1 / (1 + np.exp(-bias)))
    g, h = y - n * p, n * p * (1 - p)
    gain = lambda m: sum(g[x].sum() ** 2 / (h[x].sum() + urls.RIDGE) for x in (m, ~m))
    best = max(((f, b) for f in range(3) for b in range(3)), key=lambda s: gain(cells[:, s[0]] <= s[1]))
    assert trees[0][0][0] == best == (1, 1)
    margin = np.full(40, bias)
    for splits, leaves in trees:
        for r in range(40):
            at = 0
            while at < len(splits):
                at = 2 * at + 1 if splits[at] is None else 2 * at + 1 + int(cells[r, splits[at][0]] > splits[at][1])
            margin[r] += leaves[at - len(splits)]
    assert (((margin > 0) == (y * 2 > n)) | (y * 2 == n)).mean() > 0.9


def test_url_features_by_hand(spark):
    url = "https://a1.b-c.Example.co.uk:80/x/y_z/index.html?a=1&b=2#f"
    got = spark.createDataFrame([(url,)], "url string").select(*[c.alias(k) for k, c in urls.features(F.col("url"), {"uk": 0.25}, {"uk": 2.0}, 0.5).items()]).first()
    host, path = "a1.b-c.example.co.uk:80", "/x/y_z/index.html"
    bits = -sum(host.count(c) / len(host) * np.log2(host.count(c) / len(host)) for c in set(host))
    want = {"length": len(url), "host_length": len(host), "path_length": len(path), "depth": 3, "labels": 4, "digit_ratio": 5 / len(url), "host_digits": 3, "hyphens": 1, "path_marks": 2, "entropy": bits, "parameters": 2, "secure": 1, "suffix_rate": 0.25, "suffix_size": 2.0}
    assert got.asDict() == pytest.approx(want)


def test_word_scores_of_languages_follow_the_definition(spark):
    rng = random.Random(23)
    vocabulary = {"aa": ["house", "night", "water"], "bb": ["nacht", "wasser", "haus"]}
    train = [(" ".join(rng.choice(vocabulary[l]) for _ in range(30)), l) for l in vocabulary for _ in range(9)]
    model = language.fit_languages(spark.createDataFrame(train, "text string, lang string"))
    data, offsets = wordhash.buffers(pa.array(["Night wasser"]))
    starts, ends, script, word, first, gram = language._features(data, offsets)
    got = language._emissions(model, starts, ends, script, word, gram)
    for w, (a, b) in enumerate(zip(starts, ends)):
        plain = 0.5 * model.logs[gram[a:b]].sum(axis=0) + 0.5 * model.logs[language._word_slot(word)[w]]
        assert got[w] == pytest.approx(np.maximum(plain - plain.max(), -4 * language.SWITCH), abs=1e-3)
    counts = np.exp(model.logs[: language.GRAMS].astype(float)).sum(axis=0)
    assert counts == pytest.approx(np.ones(2), abs=1e-3) and got[0].argmax() == 0 and got[1].argmax() == 1


def test_repeated_words_meet_an_item_once():
    import time

    block = decontam.Block(["i"], pa.array(["zz " * 3000]))
    assert sum(map(len, block.at.values())) == 1
    data = pa.array(["zz " * 4000])
    words_ = next(wordhash.documents(data, wordhash.NOT_ALNUM))
    begin = time.perf_counter()
    runs, items = block.scan(words_, np.array([0, 4000]))[0]
    assert decontam._covered(runs) == 4000 and items == {0} and time.perf_counter() - begin < 2


def test_segments_are_all_maximal():
    def plain(w):
        """By definition: disjoint, each of the best score around it, by recursion on the best segment."""
        best = max(((sum(w[i:j]), -(j - i), i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, i, j = best
        return plain(w[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain(w[j:])]

    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice([-3.1, -1.3, -0.45, 0.7, 1.9, 3.3]) + rng.random() * 1e-3 for _ in range(rng.randrange(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(w))] == plain(w)


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w, bad = words(rng, 60), i % 5 == 0
        for _ in range(4 if bad else 0):
            w[rng.randrange(60)] = rng.choice(["grumble", "vexor" + rng.choice("abcdefgh") * 2])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "grumble vexorqq grumble"), (None, "plain words"), (1003, "w1 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.fit_toxicity(docs.where("doc_id % 4 <> 2 or doc_id > 900"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_texts(docs, scorer).collect()}
    held = [i for i in range(600) if i % 4 == 2]
    assert sum(got[i].predicted != (i % 5 == 0) for i in held) <= 2
    assert got[1002].predicted == 1 and [got[i].predicted for i in (1000, 1001, None, 1003)] == [0] * 4 and all(0 <= r.score <= 1 for r in got.values())
    start, end = got[1002].passages[0].start, got[1002].passages[0].end
    assert "grumble vexorqq grumble".encode()[start:end] == b"grumble vexorqq grumble"
    nothing = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_texts(docs, nothing).where("score is null").count() == 0


def test_copies_do_not_make_rare_words_significant(spark):
    rng = random.Random(8)
    copy = " ".join(f"rare{k}" for k in range(40))
    docs = spark.createDataFrame([(i, copy if i < 80 else " ".join(words(rng, 40))) for i in range(500)], "doc_id long, text string")
    scorer = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, int(i < 80)) for i in range(500)], "doc_id long, toxic int"))
    assert len(scorer.tokens) == 0


def test_language_spans(spark):
    rng = random.Random(9)
    vocabulary = {"aa": ["the", "with", "house", "night", "water"], "bb": ["über", "nacht", "wasser", "häuser", "und"], "ru": ["дом", "ночь", "вода", "это"]}
    text = lambda l, n: " ".join(rng.choice(vocabulary[l]) for _ in range(n))
    train = spark.createDataFrame([(text(l, 60), l) for l in vocabulary for _ in range(20)] + [(None, "aa"), ("x", None), ("", "bb")], "text string, lang string")
    model = language.fit_languages(train)
    assert model.langs == ["aa", "bb", "ru"]
    mixed = text("aa", 12) + " " + text("bb", 30)
    rows = [(1, text("aa", 30)), (2, text("bb", 3)), (3, text("ru", 9)), (4, mixed), (5, None), (6, ""), (7, "123 !?"), (8, text("bb", 20_000)), (None, "the water"), (9, "日本")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(docs, model, with_spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7, 8, None)] == ["aa", "bb", "ru", "bb", "und", "und", "und", "bb", "aa"]
    assert got[9].lang_pred in model.langs and all(0 <= r.score <= 1 for r in got.values())
    assert [s.lang for s in got[4].spans] == ["aa", "bb"] and mixed.encode()[got[4].spans[1].start :].decode().split()[0] in vocabulary["bb"]
    none = language.fit_languages(train.where("false"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_viterbi_matches_the_plain_recursion():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 7, 30, 12, 0, 30]
    first = np.concatenate([[0], np.cumsum(lengths)])
    e = rng.normal(size=(first[-1], 3)).astype(np.float32) * 3
    got = language.viterbi(e, first, penalty=2.0)
    for a, b in zip(first[:-1], first[1:]):
        if b == a:
            continue
        score, back = e[a].astype(float), []
        for t in range(a + 1, b):
            move = score[:, None] - 2.0 * (1 - np.eye(3))
            back.append(move.argmax(axis=0))
            score = move.max(axis=0) + e[t]
        best = [int(score.argmax())]
        for k in reversed(back):
            best.append(int(k[best[-1]]))
        value = lambda p: sum(e[a + i][x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert value(got[a:b].tolist()) == pytest.approx(value(best[::-1]), abs=1e-3)


def test_line_dedup_takes_passages_and_leaves_chance(spark):
    """A passage of clauses goes whatever stands around; a few short clauses that agree stay."""
    rng = random.Random(14)
    shared = "".join(" ".join(words(rng, 9, 10**6)) + rng.choice([", ", "; ", ". "]) for _ in range(6))
    own = lambda n: " ".join(words(rng, n, 10**6))
    texts = {i: f"{own(30)}, {shared}{own(i + 3)}, yes, no, maybe, {own(4)}" for i in range(1, 20)}
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert got[1].text == texts[1] and all(got[i].text == texts[i].replace(shared, "") and got[i].n_removed == 6 for i in range(2, 20))


def test_column_names_of_the_documents_do_not_clash(spark):
    text = "one line here\nand another\nand a third\n"
    df = spark.createDataFrame([(1, text, [9], 3, "q"), (2, text, None, 4, "q")], "doc_id long, text string, _lines array<int>, `at.x` int, starts string")
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("_host", "_f", "says", "of", "key", "_key", "_s", "_copies", "row")])
    judged = urls.judge(odd.withColumnRenamed("text", "url"), URL_RULES, urls.Trees())
    mixed = mixing.mix_sources(odd.withColumn("source", F.lit("s")))
    assert judged.count() == mixed.count() == 2 and [(r._key, r.of, r["at.x"]) for r in mixed.orderBy("doc_id").collect()] == [(1, 1, 3), (1, 1, 4)] and judged.first()["_f"] == 1
    got = linededup.dedup_lines(df.withColumn("lines", F.lit(5)).withColumn("row", F.lit(6)).withColumn("kept", F.lit(7))).orderBy("doc_id").collect()
    assert [(r.text, r["_lines"], r["at.x"], r.starts, r.lines, r.row, r.kept, r.n_removed) for r in got] == [(text, [9], 3, "q", 5, 6, 7, 0), ("", None, 4, "q", 5, 6, 7, 4)]


def test_texts_that_share_a_passage_all_count_in_training(spark):
    rng = random.Random(13)
    passage = " ".join(words(rng, 60))
    texts = [passage + " " + " ".join(words(rng, 60)) for _ in range(40)] + ["... !", "--", "?"]
    train = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate([*texts, *texts[:2] * 3, texts[0]])], "id long, text string, toxic boolean")
    got = sorted((r.text, r.toxic) for r in toxicity._without_copies(train, Tables(spark, "t")).collect())
    assert got == sorted({(r.text, r.toxic) for r in train.collect()}) and {t for t, _ in got} == set(texts)


def test_every_significant_token_is_kept(spark, monkeypatch):
    n = 70_000
    toxic = F.when(F.col("id") % 2 == 0, 200).otherwise(0)
    counts = spark.range(n).select(F.col("id").alias("token"), *[x.alias(f"{side}{f}") for f in range(toxicity.FOLDS) for side, x in (("toxic", toxic), ("other", 200 - toxic))])
    significant = toxicity._log_odds(counts)
    assert significant.count() == n
    monkeypatch.setattr(toxicity, "READ_TOKENS", 20_000)
    for tokens_, weights in toxicity._read(significant):
        assert sorted(tokens_.tolist()) == list(range(n)) and all((w > 0) == (t % 2 == 0) for t, w in zip(tokens_, weights))


def test_log_odds_follow_the_definition(spark):
    """Weights and z-scores from plain sets of tokens, each part left out once, whatever the steps of the count."""
    rng, texts = random.Random(16), []
    for i in range(240):
        w = words(rng, 30, 60)
        texts.append((" ".join(w + (["zap", "zonk" + "abc"[i % 3]] if i % 6 == 0 else [])), i % 6 == 0))
    train = toxicity._without_copies(spark.createDataFrame(texts, "text string, toxic boolean"), Tables(spark, "t"))
    rows = [(r.text.lower().split(), r.toxic, r.fold) for r in train.collect()]
    want = []
    for left_out in (None, *range(toxicity.FOLDS)):
        count = {True: collections.Counter(), False: collections.Counter()}
        for w, toxic, fold in rows:
            if fold != left_out:
                count[toxic].update({(0, x) for x in w} | {(k, x[:k]) for x in w for k in toxicity.STEMS if len(x) > k})
        n1, n0 = (sum(count[y].values()) for y in (True, False))
        found = []
        for t in count[True] | count[False]:
            y1, y0 = count[True][t], count[False][t]
            p = max(toxicity.FLOOR, toxicity.PRIOR * (y1 + y0) / (n1 + n0 + 1))
            w = np.log((y1 + p) / (n1 + toxicity.PRIOR - y1 - p)) - np.log((y0 + p) / (n0 + toxicity.PRIOR - y0 - p))
            if y1 + y0 >= 5 and abs(w / np.sqrt(1 / (y1 + p) + 1 / (y0 + p))) >= toxicity.LEAST_Z * (1 if left_out is None else (1 - 1 / toxicity.FOLDS) ** 0.5):
                found.append(w)
        want.append(sorted(found))
    for gather in (1 << 18, 50):
        toxicity.GATHER, before = gather, toxicity.GATHER
        got = toxicity._read(toxicity._log_odds(toxicity._presence(train)))
        toxicity.GATHER = before
        assert len(want[0]) >= 3 and all(sorted(w.tolist()) == pytest.approx(x) for (_, w), x in zip(got, want, strict=True))


def test_surprise_is_the_tail_of_a_sum_of_excesses():
    rng = np.random.default_rng(1)
    totals = np.array([rng.exponential(size=k).sum() for k in rng.poisson(1, 200_000)])
    for s in (0.25, 1.0, 3.0, 6.0):
        assert np.exp(-np.interp(s, toxicity._SUM, toxicity._SURPRISE)) == pytest.approx((totals >= s).mean(), rel=0.05)
    scorer = toxicity.Scorer(np.zeros(0, np.uint64), np.zeros(0))
    e = [scorer.evidence([(0, 1, s) for s in x], 10) for x in ([], [0.1], [1.2], [1.2] * 3, [1.2] * 6, [9.0])]
    assert e == sorted(e) and len(set(e)) == len(e)  # every further segment above the level counts


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(17)
    text = pa.array([" ".join(words(rng, 3000)) + " é" + "y" * 900 + ", z", "short one"])
    whole = list(wordhash.documents(text, wordhash.NOT_ALNUM))
    data, offsets = wordhash.buffers(text)
    tokens_ = toxicity._tokens(data, offsets)
    monkeypatch.setattr(wordhash, "STEP_BYTES", 200)
    for a, b in zip(whole, wordhash.documents(text, wordhash.NOT_ALNUM), strict=True):
        assert (a == b).all()
    assert all((a == b).all() for a, b in zip(tokens_[3], toxicity._tokens(data, offsets)[3], strict=True))


def test_similar_sets_count_repeated_rows_once(spark):
    rng = random.Random(12)
    shared, ends = words(rng, 54, 10**6), [words(rng, 50, 10**6) for _ in range(2)]
    texts = {1: " ".join(shared + ends[0]), 2: " ".join(shared + ends[1]), 3: " ".join([*shared, *ends[1][:-2], "x", "y"])}
    for times in ((2, 1, 1), (2, 2, 2)):
        df = spark.createDataFrame([(i, texts[i]) for i, k in zip(texts, times) for _ in range(k)], "doc_id long, text string")
        got = jaccard.similar_sets(df).collect()
        assert len(got) == sum(times) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.similar(texts)
