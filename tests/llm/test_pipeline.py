"""The pipeline's stages over a small corpus, against what each must do."""

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import prose


def test_stages(spark, tmp_path):
    item = prose(21, 40)
    docs, labels = [], []
    for i in range(120):
        bad = i % 5 == 0
        docs.append((i, prose(i, 80) + (" you idiot, you worthless moron, you scum" if bad else ""), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs += [(500, prose(7, 80), "en", "s", 0), (501, prose(300, 60) + " " + item, "en", "s", 0), (502, prose(301, 60) + ' token = "abcdefghijklmnop"', "en", "s", 0), (503, None, None, None, None), (504, "", "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, d)
        out.write.parquet(f"{d}/{k}")
        now = spark.read.parquet(f"{d}/{k}")
        ids[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if k + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i in range(120) if i % 5} | {501, 502, 503, 504}
    assert ids["toxicity"] == clean | {500}
    assert ids["near_duplicates"] == clean
    assert ids["decontamination"] == ids["secrets"] == ids["sentencepiece"] == clean - {501}
    text = spark.read.parquet(f"{d}/3").where("doc_id = 502").first()
    assert "abcdefghijklmnop" not in text["text"] and "[SECRET]" in text["text"] and text["n_chars"] == len(text["text"])
    assert now.where("doc_id = 502 AND n_tokens > 0 AND round_trip").count() == 1
    assert corpus_pipeline.run(spark, d).count() == len(clean) - 1
    assert np.array_equal(sorted(now.columns), sorted(["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]))
