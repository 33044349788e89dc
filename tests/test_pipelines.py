"""Persisting pipelines give the same rows as the registered lazy queries; K1 hook."""

import json
import re

import pytest
from pyspark.sql import functions as F

from rankloom.operators import dense
from rankloom.plans import pipelines, registry
from rankloom.plans.evaluate import evaluate_labelled
from rankloom.plans.recommend import recommend, recommend_requests
from rankloom.plans.search import TextSearch
from rankloom.sources import tables as T
from tools.oracle_check import rows_of

from conftest import SF001


def rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_index_written_and_reloaded_recommends_the_same(spark, tmp_path):
    corpus = T.document_corpus(spark, SF001)
    search = pipelines.build_index(corpus, str(tmp_path / "index"))
    man = spark.read.json(str(tmp_path / "index" / "manifest")).first()
    assert man.num_assessments == sum(1 for r in corpus.collect() if re.search(r"\w", r.text or ""))
    recs = recommend(search, T.benchmark_queries(spark, SF001), T.document_catalog(spark, SF001), 10)
    got = recs.select("query_id", "rank", F.col("key").alias("doc_id"), F.round("relevance_score", 6).alias("relevance_score"))
    assert rows(got) == rows(registry.QUERIES["recommend_batch"](spark, SF001))


def test_catalog_build(spark, tmp_path):
    pages = T.load(spark, SF001, "pages")
    catalog, profile = pipelines.build_catalog(pages, str(tmp_path / "cat"))
    lazy = registry.QUERIES["merge_catalog"](spark, SF001)
    assert rows(catalog) == rows(lazy)
    p = profile.first()
    assert p.total == p.unique_urls == lazy.count()
    assert spark.read.json(str(tmp_path / "cat" / "catalog_json")).count() == p.total


def test_evaluate_and_predict(spark, tmp_path):
    search = registry._doc_search(spark, SF001)
    q = T.benchmark_queries(spark, SF001)
    cat = T.document_catalog(spark, SF001)
    labelled = T.labelled_set(q, registry._truth(spark, SF001))
    out = pipelines.evaluate_to(search, labelled, cat, str(tmp_path), 10)
    report = json.loads(spark.read.text(f"{out}/report").first().value)
    assert report["num_queries"] == len(report["per_query_results"]) == min(10, labelled.select("Query").distinct().count())
    assert report["total_found"] == sum(r["found"] for r in report["per_query_results"])
    mean = sum(r["recall@10"] for r in report["per_query_results"]) / report["num_queries"]
    assert abs(report["mean_recall@10"] - mean) < 1e-9
    assert all(len(r["query"]) <= 83 for r in report["per_query_results"])
    pipelines.predict_to(search, q, cat, str(tmp_path / "pred"))
    pred = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "pred"))
    assert rows(pred) == rows(registry.QUERIES["prediction_rows"](spark, SF001))


@pytest.fixture(scope="module")
def small(spark):
    """A search over four documents and their catalog."""
    docs = [(1, "red apple pie with apple"), (2, "green apple tart"), (3, "blue sky over apple trees"), (4, "red brick wall")]
    corpus = spark.createDataFrame(docs, "key long, text string")
    catalog = spark.createDataFrame([(k, f"https://h/view/Item-{k}/", "t", None, "Yes", "Yes") for k, _ in docs],
                                    "key long, url string, test_type string, duration_minutes int, adaptive_support string, remote_support string")
    return TextSearch.build(corpus), catalog


def test_labels_are_found_by_text_and_compared_by_slug(spark, small):
    search, catalog = small
    rows = [("apple", "https://other/ITEM-1"), ("apple", "https://h/x/item-2/"), ("apple", "https://h/item-9"), ("apple", None),
            ("brick", "item-4//"), ("nothing known", "item-1")]
    labelled = spark.createDataFrame([(q, u, i) for i, (q, u) in enumerate(rows)], "Query string, Assessment_url string, ord long")
    per_query, done = evaluate_labelled(search, labelled, catalog, k=10, n_train=10)
    got = {r.query_text: (r.found, r.total_gt, round(r.recall, 4)) for r in per_query.collect()}
    assert got == {"apple": (2, 4, 0.5), "brick": (1, 1, 1.0), "nothing known": (0, 1, 0.0)}
    s = done.first()
    assert (s.num_queries, s.total_found, s.total_ground_truth, s.band) == (3, 3, 6, "good")
    first, _ = evaluate_labelled(search, labelled, catalog, n_train=1)
    assert [r.query_text for r in first.collect()] == ["apple"]


def test_requests_end_to_end(spark, small):
    search, catalog = small
    pages = spark.createDataFrame([(1, "https://p/1", "<p>red brick &amp; wall</p>"), (2, "https://p/1", "<p>sky</p>")],
                                  "page_id long, url string, html string")
    reqs = spark.createDataFrame(
        [("a", "apple", None, None, 2, False), ("b", "apple", "blue sky", None, 1, False), ("c", "x", "y", "https://p/1", 10, False),
         ("d", None, "", None, 10, False), ("e", "apple", None, None, 21, False), ("f", "apple", None, "https://p/none", 5, False),
         ("g", "apple", None, None, 3, True), ("h", "apple", None, None, 3, False)],
        "request_id string, query string, jd_text string, jd_url string, top_k int, use_llm boolean")
    replies = spark.createDataFrame([("g", "take [2, 2, 0]"), ("h", "[2]")], "request_id string, reply string")
    got = {}
    for r in recommend_requests(search, reqs, pages, catalog, replies).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append(r.key)
    plain = got["h"]
    assert got["a"] == plain[:2] and got["b"] == [3] and got["c"][0] == 4
    assert got["g"] == [plain[2], plain[0], plain[1]]
    assert set(got) == {"a", "b", "c", "g", "h"}          # d, f: no text; e: top_k out of range


def test_encoder_hook_unit_vectors(spark):
    def fake_encoder():
        # a deterministic "model": character counts, built once per Python worker
        import numpy as np

        def enc(texts):
            return np.array([[t.count("a") + 1, t.count("e"), len(t) % 7] for t in texts], dtype=np.float32)
        return enc

    df = spark.createDataFrame([(1, "banana"), (2, "tree"), (3, None)], "key long, text string")
    out = {r.key: r.embedding for r in dense.encode_with(df, "text", fake_encoder, 3).collect()}
    for v in out.values():
        assert abs(sum(x * x for x in v) - 1.0) < 1e-5
    top = dense.exact_top_k(spark.createDataFrame([(9, out[1])], "query_id long, embedding array<float>"),
                            spark.createDataFrame(list(out.items()), "key long, embedding array<float>"), 1)
    assert top.first().key == 1


def test_an_index_loads_by_its_manifest(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "red apple"), (2, "green tart"), (3, None)], "key long, text string")
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        pipelines.load_index(spark, path, lenient=True)
    for _ in range(2):                                  # written again: the same catalog entry, no more of them
        pipelines.build_index(corpus, path, dim=64)
        before = len(spark.catalog.listTables())
    assert pipelines.load_index(spark, path).dim == 64
    assert len(spark.catalog.listTables()) == before
    with pytest.raises(ValueError):
        pipelines.load_index(spark, path, dim=128)
    spark.createDataFrame([("other-model", 64, 2, "x")], pipelines.MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    with pytest.raises(ValueError):
        pipelines.load_index(spark, path)


def test_short_passages_are_found_verbatim(spark):
    from rankloom.plans.evaluate import containment_truth
    texts = ["abc def", "xabcx", "AB", None, "", "ab", "long words that make a passage of their own", "a  b"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    passages = ["abc", "b", "", "c d", "zz", "words that make a passage", "  "]
    queries = spark.createDataFrame(list(enumerate(passages)), "query_id long, query_text string")
    got = containment_truth(queries, corpus, TextSearch.build(corpus).index).collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, q in enumerate(passages) for j, t in enumerate(texts) if q and t is not None and q in t)
