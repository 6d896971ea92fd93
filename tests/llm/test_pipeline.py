import re

import corpus_pipeline

from sitegrid.session import stage_table

from .cases import frame
from .test_simhash import expected
from .test_spans import SECRET


def test_stages_on_awkward_rows(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage_table(stage(spark, docs, ""))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0
        rows = out.collect()
        if name == "simhash_near_dedup":
            known = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
            keep = {c for _, _, c in expected(known)}
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(keep)
        elif name == "line_dedup":
            assert len(rows) == docs.count()
        docs = out
    packed = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) >= docs.count()


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = corpus_pipeline.quality_rules(spark, docs, folder)
    assert 0 < judged.count() < docs.count()
    masked = corpus_pipeline.secret_scans(spark, docs, folder).collect()
    assert len(masked) == docs.count()
    for r in masked:
        for p, ok in SECRET.values():
            assert not any(ok(m) for m in re.finditer(p, r.text) if "[secret]" not in m[0])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert packed and {r.doc_id for r in packed} <= {r.doc_id for r in judged.collect()}
