import random

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as E
from rankloom.llm import langid, queries, simhash
from rankloom.llm.shared import Scratch

SF = "/root/testdata/sf0.001"


def test_registered():
    found = E.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in found}
    assert found["pipeline"] is corpus_pipeline.run and "pipeline" not in E.oracle_sql()
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_every_stage_does_its_operators_work(spark):
    """Each stage's rows are those that the operator itself would keep."""
    docs = queries.read(spark, SF, "documents")
    scratch = Scratch(spark, "test")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = scratch.write(stage(spark, docs, SF), str(k))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if k == 0:
            kept = langid.predict(docs, langid.learn(docs), ["doc_id"]).filter("lang_pred <> 'und' and score >= 0.5 and known >= 0.25")
        elif k == 1:
            from rankloom.llm import quality
            kept = quality.classify(docs, queries.read(spark, SF, "labels")).filter("predicted = 1")
        else:
            kept = simhash.near_duplicates(docs).filter("doc_id = component_id")
        assert ids(out) == ids(kept), name
        assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
        docs = out
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(ids(docs))


def test_clean_documents_stay_and_junk_goes(spark):
    docs, marks = queries.read(spark, SF, "documents"), queries.read(spark, SF, "labels").toPandas()
    out = corpus_pipeline.quality_classifier(spark, corpus_pipeline.language_id(spark, docs, SF), SF)
    kept = {r.doc_id for r in out.collect()}
    good, bad = set(marks[marks.quality == 1].doc_id), set(marks[marks.quality == 0].doc_id)
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.2 * len(bad)


def test_stages_take_odd_tables(spark, docs_of):
    odd = docs_of([(1, None, None, None), (2, "", "en", "s"), (3, "the of and to in " * 30, "en", "s"), (None, "the of and", "en", None),
                   (3, "the of and to in " * 30, "en", "s")])
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    assert 3 in [r.doc_id for r in docs.collect()]
    none = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_long_texts_of_no_learned_language_go(spark):
    docs = queries.read(spark, SF, "documents")
    rng = random.Random(1)
    gibberish = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(200))
    code = "static void free_list(struct node *head) { while (head) { struct node *next = head->next; free(head); head = next; } } " * 5
    finnish = ("Suomen kieli on uralilaisten kielten ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset. "
               "Suomessa suomen kielen puhujia oli vuoden lopussa noin viisi miljoonaa. ") * 5
    texts = [gibberish, code, finnish, "the", "le de la"]
    added = spark.createDataFrame([(10 ** 9 + i, t, None, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(added.select(*[F.col(c).cast(t) for c, t in docs.dtypes]))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, SF).collect()}
    assert {i for i in kept if i >= 10 ** 9} == {10 ** 9 + 3, 10 ** 9 + 4}
    marks = queries.read(spark, SF, "labels").filter("quality = 1").toPandas()
    assert set(marks.doc_id) <= kept
