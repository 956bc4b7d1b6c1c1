"""The pipeline's stages: what each drops, against the operators' own results."""

import corpus_pipeline
from codexa.llm import decontaminate, line_dedup, near_dedup, packing, quality_lm
from tests.llm.helpers import awkward, none_of
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_each_stage_against_its_decisions(spark):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    kept = stages["quality_classifier"](spark, docs, SF).cache()
    assert ids(kept) == ids(quality_lm.scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("accepted")) and kept.columns == docs.columns
    gone = {(r["doc_id"], r["line_no"]) for r in line_dedup.repeated_lines(kept).collect()}
    want = {}
    for r in kept.collect():
        text = "\n".join(x for k, x in enumerate((r["text"] or "").split("\n")) if (r["doc_id"], k) not in gone)
        if text.strip() or text == r["text"]:
            want[r["doc_id"]] = text
    left = stages["line_dedup"](spark, kept, SF).cache()
    assert {r["doc_id"]: r["text"] for r in left.collect()} == want and left.columns == docs.columns
    one = stages["minhash_near_dedup"](spark, left, SF).cache()
    assert ids(one) == ids(left) - {r["doc_id"] for r in near_dedup.near_copies(left).collect()}
    clean = stages["benchmark_decontamination"](spark, one, SF).cache()
    assert ids(clean) == ids(one) - {r["doc_id"] for r in decontaminate.leaks(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    final = stages["best_fit_packing"](spark, clean, SF)
    assert ids(final) == ids(clean.where("octet_length(text) > 0"))
    assert sorted(map(str, final.collect())) == sorted(map(str, packing.packed(clean).collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def test_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), none_of(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "piece", "start", "size", "bin", "bin_start"]
        docs.collect()
