"""The pipeline stage by stage."""

import corpus_pipeline
from tidewell.llm.common import scratch, table

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_the_last_tells_all_documents(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{scratch(spark)}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5] > 0
    assert docs.where("not exact and n_chars > 0").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, class long, key string, row int, text_sha256 string"


def test_stages_on_nulls_empty_repeated_and_clashing_rows(spark):
    base, long = " ".join(f"w{k % 977}x{k % 131}" for k in range(400)), " ".join(f"v{k}" for k in range(20_000))
    rows = [(1, base, "en", "web"), (2, base, "en", "web"), (2, base, "en", "web"), (3, base.replace("w5x5 ", "other "), None, None), (4, None, "en", "web"), (5, "", None, None), (None, base, "en", "web"), (None, None, None, None), (6, long, "en", "code"), (7, "short", "xx", "web"), (7, "another", "en", "web")]
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 9, "k", 8, "z") for i, t, lang, s in rows], ODD)
    for table_ in (docs, docs.limit(0)):
        now, counts = table_, []
        for name, stage in corpus_pipeline.STAGES:
            path = f"{scratch(spark)}/{name}"
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
            counts.append(now.count())
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns
                assert {(r["class"], r["key"], r["row"], r["text_sha256"]) for r in now.collect()} <= {(9, "k", 8, "z")}
            if name == "simhash_near_dedup" and counts[0]:
                kept = [r["doc_id"] for r in now.collect()]
                assert kept.count(1) == 1 and not {2, 3, 5} & set(kept) and kept.count(None) == 2 and kept.count(7) == 2 and {4, 6} <= set(kept)
        assert counts == [0] * 5 or counts[3] == counts[4] > 0
