import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from test_decontaminate import brute as windows
from test_neardup import brute as groups

import corpus_pipeline as C
from corvane.llm import bpe, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of each stage over the smallest table with odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(3)
    odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "the and of the in", "en", None, 3), (10**6 + 1, "漢字" * 50, None, "s", 100), (10**6 + 2, "", "en", "s", 0), (10**6 + 3, "mail 34@mail7.example.com the and of", "en", "s", 9)], docs.schema)
    docs = docs.unionByName(first).unionByName(odd)
    out = []
    for name, stage in C.STAGES:
        after = stage(spark, docs, SF)
        out.append((name, docs.columns, docs.collect(), after.columns, after.collect()))
        docs = spark.createDataFrame(out[-1][4], after.schema)
    return {x[0]: x[1:] for x in out}


def test_columns_stay(stages):
    assert all(x[0] == x[2] for name, x in stages.items() if name != "encoding")


def test_language_keeps_labelled_text_and_drops_the_rest(stages):
    _, before, _, after = stages["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {10**6, 10**6 + 1, 10**6 + 2}


def test_one_document_of_each_group_stays(stages):
    _, before, _, after = stages["near_duplicates"]
    kept = {d for d, _, _, ok in groups([(r.doc_id, r.text) for r in before]) if ok}
    assert sorted((r.doc_id for r in after), key=str) == sorted(kept, key=str)


def test_benchmark_passages_go(spark, stages):
    _, before, _, after = stages["benchmark"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in windows([(r.doc_id, r.text) for r in before], items) if not r[5]}
    assert {r.doc_id for r in after} == clean and len(after) < len(before)


def test_personal_data_are_masked(stages):
    _, before, _, after = stages["personal_data"]
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    assert all(texts[r.doc_id] == pii.masked(r.text) for r in before)
    assert "[EMAIL]" in texts[10**6 + 3] and all(r.n_chars == len(r.text) for r in after)
    assert not any(pii.base_spans(t) for t in texts.values())


def test_encoding_is_the_librarys(stages):
    _, before, columns, after = stages["encoding"]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in after}
    assert len(after) == len(before) and columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    for r in before:
        assert got[r.doc_id].ids == library.encode_ordinary(r.text)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_equals_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
