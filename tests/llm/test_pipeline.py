import corpus_pipeline
from strandframe.llm import queries
from strandframe.llm.common import stored
from tests.llm import brute
from tests.llm.test_near_copies import kept_plainly
from tests.llm.test_rows import plain_measures
from tests.llm.test_tokens import _LIB, BYTES, check_packing

DATA = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made.append(stored(stage(spark, made[-1], DATA), name))
        assert made[-1].schema == docs.schema
    texts = [{r.doc_id: r.text for r in m.collect()} for m in made]
    kept = {r.doc_id for r in queries.op4_quality_ledger(spark, DATA).where("kept").collect()}
    assert set(texts[1]) == kept and all(plain_measures(t)[0] >= 50 for t in texts[1].values())
    assert set(texts[2]) <= set(texts[1]) and len(texts[2]) >= 0.99 * len(texts[1])
    assert set(texts[3]) == kept_plainly(texts[2])
    ids = sorted(texts[3])
    for i, (n, gone, _, _) in zip(ids, brute.removed([texts[3][i] for i in ids], corpus_pipeline.PASSAGE_BYTES), strict=True):
        left = len(texts[4][i].encode())
        assert n - gone - 8 * (gone > 0) <= left + 8 and left <= n - gone
        assert gone or texts[4][i] == texts[3][i]
    rows = corpus_pipeline.run(spark, DATA).collect()
    ids_of = {i: [*_LIB[BYTES].encode(t, add_special_tokens=False).ids, 0] for i, t in texts[4].items()}
    assert check_packing(rows, ids_of) < 0.02


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "empty")
    assert docs.count() == 0
