import inspect

import corpus_pipeline
from folioflow.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_run_equals_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == counts[-1] and all(r["exact"] for r in out)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    coder = bpe.Coder(bpe.read_ranks(bpe.RANKS))
    assert all(coder.decode(r["tokens"]).decode() == kept[r["doc_id"]] for r in out)


def test_stages_take_session_docs_and_folder():
    assert [len(inspect.signature(f).parameters) for _, f in corpus_pipeline.STAGES] == [3] * 5
