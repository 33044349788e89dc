"""File sources and sinks."""

import json
import os

import pytest

from rankloom.operators.metrics import per_query_metrics, summary
from rankloom.sources import files


CATALOG = [
    ("Java 8 (New)", "https://h/view/java-8-new/", "Multi-choice test", 0, "Technical Skills", "Yes", "Yes"),
    ("Verbal Ability", "https://h/view/verbal/", "d" * 700, None, "Cognitive Ability", "Unknown", "No"),
    ("Ödeme Süreci", "https://h/view/odeme/", "Açıklama", 30, "General Assessment", "No", "Yes"),
]


def test_catalog_json_round_trip(spark, tmp_path):
    src = tmp_path / "catalog.json"
    keys = [f.name for f in files.CATALOG_SCHEMA.fields]
    src.write_text(json.dumps([dict(zip(keys, r)) for r in CATALOG], ensure_ascii=False, indent=2), encoding="utf-8")
    cat = files.read_catalog_json(spark, str(src))
    assert sorted(tuple(r) for r in cat.collect()) == sorted(CATALOG, key=lambda r: r)
    out = str(tmp_path / "out_json")
    files.write_catalog_json(cat, out)
    back = files.read_catalog_json(spark, out, multiline=False)
    assert sorted(tuple(r) for r in back.collect()) == sorted(CATALOG)
    csv_out = str(tmp_path / "out_csv")
    files.write_csv(cat, csv_out)
    assert spark.read.option("header", True).csv(csv_out).count() == 3


def test_labelled_csv_multiline(spark, tmp_path):
    p = tmp_path / "labels.csv"
    p.write_text('Query,Assessment_url\n"Hiring a java dev,\nremote",https://h/view/java/\n'
                 '"Hiring a java dev,\nremote",https://h/view/java/\nplain,\n', encoding="utf-8")
    df = files.read_labelled_csv(spark, str(p)).orderBy("ord").collect()
    assert [r.Query for r in df] == ["Hiring a java dev,\nremote"] * 2 + ["plain"]
    assert df[2].Assessment_url is None


def test_vectors_and_manifest(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0])], "key long, embedding array<float>")
    files.write_vectors(v, str(tmp_path / "idx"), "hashing-4096")
    vecs, man = files.read_vectors(spark, str(tmp_path / "idx"))
    assert vecs.count() == 2
    m = man.first()
    assert (m.model_name, m.dimension, m.num_assessments) == ("hashing-4096", 2, 2)


def test_vectors_lenient(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0])], "key long, embedding array<float>")
    base = tmp_path / "idx2"
    files.write_vectors(v, str(base), "m")
    os.rename(base / "vectors", base / "moved")
    with pytest.raises(Exception):
        files.read_vectors(spark, str(base))
    vecs, _ = files.read_vectors(spark, str(base), lenient=True)
    assert vecs.count() == 0


def test_evaluation_and_predictions(spark, tmp_path):
    preds = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "query_id long, rank int, item string")
    truth = spark.createDataFrame([(1, "a"), (2, "z")], "query_id long, item string")
    texts = spark.createDataFrame([(1, "q" * 90), (2, "short")], "query_id long, query_text string")
    pq = per_query_metrics(preds, truth, 10).join(texts, "query_id")
    out = files.write_evaluation(pq, summary(pq), str(tmp_path), 10)
    s = json.loads(spark.read.text(f"{out}/report").first().value)
    assert s["num_queries"] == 2 and s["total_found"] == 1 and abs(s["mean_recall@10"] - 0.5) < 1e-12
    assert s["per_query_results"] == [
        {"query": "q" * 80 + "...", "recall@10": 1.0, "precision@10": 0.1, "found": 1, "total_gt": 1},
        {"query": "short", "recall@10": 0.0, "precision@10": 0.0, "found": 0, "total_gt": 1}]
    assert spark.read.json(f"{out}/per_query").count() == 2
    assert os.path.basename(out).startswith("evaluation_results_") and len(os.path.basename(out)) == 34
    p = spark.createDataFrame([("q", "https://h/a/")], "Query string, Assessment_url string")
    files.write_predictions(p, str(tmp_path / "pred"))
    assert spark.read.option("header", True).csv(str(tmp_path / "pred")).columns == ["Query", "Assessment_url"]


def test_request_resolution_by_page_join(spark):
    from rankloom.plans.requests import resolve_requests

    pages = spark.createDataFrame(
        [(1, "https://h/a", "<html><body><script>x()</script><p>Senior  Java\\n role</p></body></html>"),
         (2, "https://h/b", "<p>unused page</p>"), (3, "https://h/a", "<p>the same url again</p>")],
        "page_id long, url string, html string")
    reqs = spark.createDataFrame(
        [(1, "q1", "jd", "https://h/a", 10), (2, "q2", "jd", "https://h/zz", 10),
         (3, "q3", "", None, 10), (4, None, "pasted", "", 25)],
        "request_id long, query string, jd_text string, jd_url string, top_k int")
    rows = resolve_requests(reqs, pages).collect()
    assert len(rows) == 4                                  # of two pages with one url the first counts
    got = {r.request_id: r for r in rows}
    assert got[1].source == "url" and "Senior" in got[1].final_text and "x()" not in got[1].final_text
    assert got[1].reject_reason is None
    assert got[2].final_text == "" and got[2].reject_reason == "no input"     # unknown page: no fallback
    assert got[3].source == "query" and got[3].final_text == "q3"
    assert got[4].source == "jd_text" and got[4].reject_reason == "top_k out of range"
