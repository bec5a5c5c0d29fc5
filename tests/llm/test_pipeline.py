import importlib.util

import pytest
from pyspark.sql import functions as F

from drivetrove.llm.common import materialize, table
from drivetrove.llm.quality import quality

from .test_contamination import brute as contaminated
from .test_mixing import check
from .test_neardup import brute as duplicates
from .test_pii import brute as private

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from corpus_pipeline import ORACLE_SQL, STAGES, run

    assert ORACLE_SQL is None and len(STAGES) == 5
    docs = table(spark, SF, "documents")
    docs = docs.unionByName(docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000))
    rows = {r["doc_id"]: r for r in docs.collect()}
    verdict = {r["doc_id"]: r["kept"] for r in quality(docs, table(spark, SF, "labels")).collect()}

    good = materialize(STAGES[0][1](spark, docs, SF))
    assert good.schema == docs.schema
    kept = [r["doc_id"] for r in good.collect()]
    assert sorted(kept) == sorted(i for i in rows if verdict[i]) and 0.5 * len(rows) < len(kept) < len(rows)

    single = materialize(STAGES[1][1](spark, good, SF))
    assert single.schema == docs.schema
    want = sorted(d for d, _, _, k in duplicates([(i, rows[i]["text"]) for i in kept]) if k)
    assert sorted(r["doc_id"] for r in single.collect()) == want and len(want) < len(kept)

    clean = materialize(STAGES[2][1](spark, single, SF))
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = [i for i in want if not contaminated(rows[i]["text"], items)[0][4]]
    assert clean.schema == docs.schema and sorted(r["doc_id"] for r in clean.collect()) == want

    masked = materialize(STAGES[3][1](spark, clean, SF))
    assert masked.schema == docs.schema and masked.count() == len(want)
    for r in masked.collect():
        old = rows[r["doc_id"]]
        for _, a, b in private(old["text"]):
            assert old["text"][a:b] not in r["text"]
        assert r["text"] == old["text"] or r["n_chars"] == len(r["text"])

    mixed = STAGES[4][1](spark, masked, SF).collect()
    assert sorted(r["doc_id"] for r in mixed) == want
    check(mixed, 64)

    whole = run(spark, SF)
    assert sorted(whole.columns) == sorted(mixed[0].asDict()) and whole.count() > 0


def test_odd_rows(spark):
    from corpus_pipeline import STAGES

    text = "word of a text that is long enough to stay here for all the rules that there are"
    rows = [(1, text, None, None, None, 1, 2), (None, text + " x", "en", "s", 1, 1, 2), (2, None, "en", "s", 0, 1, 2), (3, "", None, "s", 0, 1, 2), (1, text, None, None, None, 1, 2), (5, "long " * 30000, "en", "s", 3, 1, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, set_key int"
    for given in (spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema).limit(0)):
        docs = given
        for _, stage in STAGES[:4]:
            docs = stage(spark, docs, SF)
            assert docs.schema == given.schema
            docs = materialize(docs)
        out = STAGES[4][1](spark, docs, SF).collect()
        assert len(out) == docs.count()
