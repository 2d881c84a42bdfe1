import public_tokenizers
import tiktoken
from test_bpe import PLAIN
from test_decontaminate import brute as contaminated
from test_join import plain as component_rows
from test_pii import brute as spans_of

import corpus_pipeline
from lintmill.llm.pii import masked
from lintmill.llm.quality_rules import judge_quality

assert isinstance(PLAIN, tiktoken.Encoding) and public_tokenizers.PATTERN


def test_against_plain_stages(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    good = {r.doc_id for r in judge_quality(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    stay = {i for i, _, c in component_rows(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in stay]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{given}/benchmark.parquet").collect()]
    bad = {int(i) for i, _, n, _ in contaminated(rows, items, 10) if n}
    expected = {i: PLAIN.encode_ordinary(masked(t, spans_of(t))) for i, t in rows if i not in bad}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, given).collect()}
    assert got == expected and 0 < len(got) < docs.count()


def test_stages_keep_columns_and_survive_odd_rows(spark, docs, given):
    good = " ".join(f"word{i}" for i in range(60))
    frame = docs([(1, None), (1, None), (2, good), (2, good), (3, good + " x"), (None, "y " + good + " bob@x.com"), (4, "")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, given)
        assert set(docs([]).columns) == set(frame.columns)
    last = corpus_pipeline.STAGES[-1][1](spark, frame, given)
    assert "ids" in last.columns and last.count() == frame.count() == 1


def test_empty_table(spark, docs, given):
    frame = docs([], False)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, given)
    assert frame.count() == 0
