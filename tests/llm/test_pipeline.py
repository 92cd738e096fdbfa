"""The stages against plain versions, and the registered oracles."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from codelattice.llm import langid, tokens
from codelattice.llm.queries import ORACLES, PACK_VOCABULARY, QUERIES, vocabulary
from tests.compare import compare, connect
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES, ORACLES) == "ok"


def _plain(docs, bench):
    """The rows each stage keeps, ``id -> text``."""
    letters = regex.compile(r"\p{L}")
    kept = {d: t for d, t in docs if t is not None and letters.search(t)}
    yield kept
    groups = brute.near_duplicates(kept.items())
    kept = {d: t for d, t in kept.items() if groups[d][0] == d}
    yield kept
    seen, out = set(), {}
    for d, t in sorted(kept.items()):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        out[d] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    yield out
    yield {d: t for d, t in out.items() if not brute.contamination(t, bench)[4]}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(5000, None), (5001, ""), (5002, "123 456"), (5003, docs.first().text)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    plain = _plain([(r.doc_id, r.text) for r in docs.collect()], bench)
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        columns = docs.columns
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == want
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    encoder = tokens.Encoder.of(vocabulary(PACK_VOCABULARY)).tokenizer
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert lengths == {d: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}


def test_run_and_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    folder = str(tmp_path)
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_no_text_is_lost_for_being_short():
    model = langid.fit([("the of and", "en"), ("le la les", "fr")])
    column = pa.array(["a", "the", "le"])
    assert np.isin(model.decode(model.margins(np.frombuffer(b"athele", np.uint8), np.array([0, 1, 4, 6])))[0], [0, 1]).all() and len(column) == 3


def test_queries_are_registered():
    import __spark_entry__

    assert [f"op{n}" for n in range(1, 14)] == sorted({q.split("_")[0] for q in QUERIES}, key=lambda q: int(q[2:]))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and F is not None
