"""Operators on hand-computed fixtures, and invariants."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import corpus, duplicates, evaluate, graph, index, mining, rank, recommend, retrieve
from textloom.sources import io, pages

DOCS = [
    ("D1", "The stock market crash hit food market prices."),
    ("D2", "Stock market prices rose; long-term policy reform followed."),
    ("D3", "The prime minister announced an economic policy."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, "news", d, t) for d, t in DOCS], "doc_id string, category string, title string, text string")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_phrases(docs):
    tokens = X.preprocess_lab(F.col("text"))
    q = {"p": X.query_tokens_lab("stock market prices")}
    rows, pairs = index.token_rows(docs, tokens), index.biwords(docs, tokens)
    assert ids(retrieve.phrase_biword(pairs, q)) == ["D1", "D2"]
    assert ids(retrieve.phrase_positional(rows, q)) == ["D2"]
    row = retrieve.phrase_comparison(pairs, rows, q | {"one": ["policy"]}).orderBy("qid").collect()
    assert [tuple(r)[:4] for r in row] == [("one", 0, 2, 0), ("p", 2, 1, 1)]


def test_boolean(docs):
    posted = index.postings(index.token_rows(docs, X.preprocess_lab(F.col("text"))))
    run = lambda q: ids(retrieve.boolean_search(posted, docs, q))
    assert run("stock AND policy") == ["D2"]
    assert run("crash OR minister") == ["D1", "D3"]
    assert run("policy NOT stock") == ["D3"]
    assert run("NOT prices") == ["D3"]
    assert run("crash OR minister policy") == ["D1", "D2", "D3"]  # an operator holds until the next one
    assert run("the") == [] and run("") == []


def test_ids(spark):
    rows = spark.createDataFrame([("D3", 1), ("D3", 2), ("D4", 3)], "doc_id string, n int")
    assert ids(corpus.repair_ids(rows, F.col("n"))) == ["D3", "D3_dup1", "D4"]
    assert ids(corpus.synthesize_ids(rows.select("n"))) == ["D0001", "D0002", "D0003"]
    assert corpus.text_column(spark.createDataFrame([("a", "b")], "doc_id string, body string")) == "body"


def test_merge_is_idempotent(docs):
    base = corpus.content(docs)
    once = corpus.merge(base, base)
    assert sorted(once.collect()) == sorted(base.collect()) == sorted(corpus.merge(once, base).collect())


def test_micro_graph(spark):
    links = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("a", "d", 1)], "src string, dst string, pos long")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "url string")
    visited, queue = graph.crawl_order(nodes, links, ["a"], 3, 100)
    assert sorted((r.url, r.depth) for r in visited.collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    assert queue.count() - visited.count() == 1
    scores = {r.node: r.score for r in graph.pagerank(links).collect()}
    assert abs(sum(scores.values()) - 1) < 1e-9 and scores["a"] > scores["d"] * 0.5
    found = graph.hits(links, tol=1e-8, max_iter=30).collect()
    assert abs(sum(r.hub**2 for r in found) - 1) < 1e-6


def test_page_cap_keeps_queue_order(spark):
    links = spark.createDataFrame([("h", f"p{i}", i) for i in range(6)] + [("p0", "q", 0)], "src string, dst string, pos long")
    nodes = spark.createDataFrame([("h",), ("q",)] + [(f"p{i}",) for i in range(6) if i != 1], "url string")
    visited, _ = graph.crawl_order(nodes, links, ["h"], 2, 4)
    assert sorted(r.url for r in visited.collect()) == ["h", "p0", "p2", "p3"]  # p1 cannot be fetched


def test_page_cap_far_above_the_pages(spark):
    links = spark.createDataFrame([("h", f"p{i}", i) for i in range(50)], "src string, dst string, pos long")
    nodes = spark.createDataFrame([("h",)] + [(f"p{i}",) for i in range(50)], "url string")
    assert graph.crawl_order(nodes, links, ["h"], 2, 10**9)[0].count() == 51


def test_text_files_share_a_numbering(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.txt").write_text("three")
    assert sorted(map(tuple, io.read_text(spark, str(tmp_path)).collect())) == [("D001", "one"), ("D002", "two"), ("D003", "three")]


def test_confusion_has_empty_cells(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "b", "a")], "doc_id long, label string, prediction string")
    assert sorted(map(tuple, mining.confusion(rows).collect())) == [("a", "a", 1), ("a", "b", 0), ("b", "a", 1), ("b", "b", 0)]


def test_links_of_crawls_are_united(spark):
    one = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert graph.unite_links([one, one.filter("src = 'a'")]).count() == 2


def test_crawl_flags(spark):
    page = "url string, title string, text string, category string, source_type string, is_exact_duplicate boolean, is_near_duplicate boolean, duplicate_of string, doc_id string"
    words = [f"w{i}" for i in range(40)]
    rows = [("s", "start"), ("a", " ".join(words)), ("b", " ".join(words).upper() + " "), ("c", " ".join(words[:38] + ["x", "y"])), ("d", "quite other words")]
    table = spark.createDataFrame([(u, u, t, "c", "dataset", False, False, None, u) for u, t in rows], page)
    links = spark.createDataFrame([("s", u, i) for i, u in enumerate("abcd")], "src string, dst string, pos long")
    meta, texts, edges, stats = graph.crawl(table, links, ["s"], 1, 10)
    found = {r.id: (r.is_exact_duplicate, r.is_near_duplicate, r.duplicate_of) for r in meta.collect()}
    assert found == {"s": (0, 0, None), "a": (0, 0, None), "b": (1, 0, "a"), "c": (0, 1, "a"), "d": (0, 0, None)}
    assert sorted(r.id for r in texts.collect()) == ["a", "c", "d", "s"]
    row = stats.first()
    assert (row.pages_fetched, row.pages_skipped_content_dup, row.near_duplicates_flagged, row.max_depth_reached, row.pages_skipped_url_dup) == (5, 1, 1, 1, 0)


def test_metrics_by_hand(spark):
    runs = spark.createDataFrame([("m", "q", i + 1, d) for i, d in enumerate("xayb")], "method string, qid string, rank int, doc_id string")
    qrels = spark.createDataFrame([("q", d) for d in "abc"], "qid string, doc_id string")
    row = evaluate.evaluate(runs, qrels, 3).first()
    assert tuple(row)[2:] == (0.5, 0.6667, 0.5714, 0.3333, 0.3333, 0.3333, 0.5, 0.2961)
    assert {r.qid for r in evaluate.with_mean(evaluate.evaluate(runs, qrels, 3)).collect()} == {"q", "MEAN"}


def test_reranking_keeps_the_set(spark):
    base = spark.createDataFrame([("q", i, s) for i, s in enumerate((0.9, 0.5, 0.1))], "qid string, doc_id long, relevance_score double")
    link = spark.createDataFrame([(2, 1.0), (7, 0.0)], "doc_id long, link_score double")
    out = rank.rerank(base, link, 0.3).orderBy("new_rank").collect()
    assert [(r.doc_id, r.rank_change) for r in out] == [(2, 2), (0, -1), (1, -1)]
    single = rank.rerank(base.limit(1), link).first()
    assert single.blended_score == 0.0  # one result scales to 0


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    base = [[f"t{rng.randrange(300)}" for _ in range(30)] for _ in range(5)]
    texts = [" ".join(x if rng.random() > 0.03 else "z" for x in base[i % 5]) for i in range(40)]
    found = {r.doc_id: r.duplicate_of for r in duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(t.split()) for t in texts]
    want = {}
    for b in range(40):
        for a in range(b):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85:
                want[b] = a
                break
    assert found == want


def test_rake(spark):
    rows = mining.rake(spark.createDataFrame([(1, "deep learning and deep nets with the cat"), (2, "the of"), (3, None)], "doc_id long, text string")).collect()
    assert [(r.phrase, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [("deep learning", 4.0), ("deep nets", 4.0), ("cat", 1.0)]


def test_singleton_classes_are_dropped(spark):
    docs = spark.createDataFrame([(i, "a" if i < 8 else "b" if i < 16 else "lonely", "t", f"alpha{i % 2} beta" if i < 8 else "gamma delta") for i in range(17)], "doc_id long, category string, title string, text string")
    found = mining.classify(docs).collect()
    assert {r.label for r in found} == {"a", "b"} and all(r.label == r.prediction for r in found) and len(found) == 4


def test_ratings_and_svd(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "t", f"w{i}") for i in range(30)], "doc_id long, category string, title string, text string")
    ratings = recommend.synthetic_ratings(docs, users=8)
    rows = ratings.collect()
    assert len({(r.user_id, r.doc_id) for r in rows}) == len(rows) and {r.rating for r in rows} <= {1, 2, 3, 4, 5}
    best = recommend.collaborative(ratings, "U001", 3, 4).collect()
    assert len(best) == 3 and not {r.doc_id for r in best} & {r.doc_id for r in rows if r.user_id == "U001"}
    assert recommend.collaborative(ratings, "nobody").count() == 0


def test_store_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    assert io.load_corpus(spark, path) is None and io.store_size_kb(spark, path) == 0.0
    io.init_store(spark, path)
    assert io.load_corpus(spark, path)[0].count() == 0
    io.save_corpus(*corpus.base_corpus(docs, io.fetch_articles(spark)), path)
    meta, texts = io.load_corpus(spark, path)
    assert meta.count() == texts.count() == 13 and len(meta.columns) == 14
    io.write_csv(io.components(spark), str(tmp_path / "csv"))
    assert io.read_csv(spark, str(tmp_path / "csv")).count() == 7
    assert "documents: 13" in io.summary_markdown(corpus.dashboard(meta))


def test_text_source(spark, tmp_path):
    (tmp_path / "in.txt").write_text("one\nline\n\n  two \n \n\n\nthree")
    assert [tuple(r) for r in io.read_text(spark, str(tmp_path / "in.txt")).collect()] == [("D001", "one\nline"), ("D002", "two"), ("D003", "three")]


def test_page_fields(spark):
    html = "<title> A <b>b</b></title><a href='http://x/1'>x</a> <a HREF=\"http://x/1#f\">y</a><a href='/rel'>z</a>"
    row = pages.parse_pages(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).orderBy("url").collect()
    assert (row[0].title, row[0].outlinks) == ("A b", ["http://x/1"]) and (row[1].title, row[1].text) == ("v", "")


def test_tree_helpers():
    assert retrieve.median_first(list("abcde")) == ["c", "a", "b", "d", "e"]
    assert retrieve.btree_height(0) == (0, 0) and retrieve.btree_height(7, 4) == (1, 2)


def test_stream_merges_once(spark, tmp_path):
    from textloom.streaming import incremental

    schema = "id string, text string, ts timestamp"
    source, store = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.createDataFrame([("a", "same words"), ("b", "SAME  words"), ("c", "others")], "id string, text string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    first.coalesce(1).write.parquet(source)
    fresh = incremental.fresh_pages(spark.readStream.schema(schema).parquet(source), "ts")
    incremental.merge_stream(fresh, store, str(tmp_path / "cp")).awaitTermination()
    assert incremental.current(spark, store).count() == 2
    spark.createDataFrame([("c", "a later version"), ("d", "new words")], "id string, text string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01"))).coalesce(1).write.mode("append").parquet(source)
    again = incremental.fresh_pages(spark.readStream.schema(schema).parquet(source), "ts")
    incremental.merge_stream(again, store, str(tmp_path / "cp")).awaitTermination()
    found = {r.id: r.text for r in incremental.current(spark, store).collect()}
    assert len(found) == 3 and found["c"] == "others" and found["d"] == "new words"
