import corpus_pipeline as cp
from stressloom.llm import decontaminate, line_dedup, mixing, near_dups, toxicity


def test_stages_in_order():
    assert [f for _, f in cp.STAGES] == [toxicity.stage, line_dedup.stage, near_dups.stage, decontaminate.stage, mixing.stage]


def test_each_stage_works_on_what_its_predecessor_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in cp.STAGES:
        docs = cp.store(stage(spark, docs, sf), name)
        assert docs.count() <= rows and (docs.columns == columns or name == "mixing")
        rows = docs.count()
    assert [r.doc_id for r in docs.orderBy("doc_id").collect()] == [r.doc_id for r in cp.run(spark, sf).orderBy("doc_id").collect()]


def test_odd_rows_pass_all_stages(spark, odd, none, clash, sf):
    for docs in (odd, none, clash):
        for name, stage in cp.STAGES:
            docs = cp.store(stage(spark, docs, sf), name)
        docs.count()
