import random

import corpus_pipeline
from tests.llm import cases


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, cases.prose(rng, 120)) for i in range(120)]
    for i in range(0, 120, 8):
        rows[i] = (i, rows[i][1] + " idiot scum moron")
    bench = cases.prose(rng, 25)
    rows += [(200, rows[1][1]), (201, cases.prose(rng, 60) + " " + bench + " " + cases.prose(rng, 60)), (202, None), (203, "")]
    near = cases.prose(rng, 36).split(" ")
    rows += [(204, " ".join(near)), (205, " ".join([*near[:17], "other", *near[18:]]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 120 and i % 8 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    kept, x = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, x, d)
        assert x.columns == docs.columns
        kept.append({r.doc_id for r in x.collect()})
    toxic = set(range(0, 120, 8))
    every = {i for i, _ in rows}
    assert kept[0] == every - toxic
    assert kept[1] == kept[0] - {200}
    assert kept[2] <= kept[1] and {202, 203, 204} <= kept[2]
    assert kept[3] == kept[2] - {201}
    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.collect()} == kept[3]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"]


def test_nulls_repeated_ids_extra_columns_and_an_empty_corpus(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, cases.prose(rng, 90)) for i in range(12)] + [(3, cases.prose(rng, 80)), (None, cases.prose(rng, 70)), (None, None), (20, None), (21, ""), (22, cases.prose(rng, 30_000)), (23, rows_of := cases.prose(rng, 60)), (24, rows_of)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, gone int, spans string"
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, cases.prose(rng, 25)), (1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in ([(i, t, None, "s", len(t or ""), 0.1, 1, "x") for i, t in rows], []):
        x = spark.createDataFrame(docs, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            x = stage(spark, x, str(tmp_path))
            assert x.columns == schema.replace(",", "").split(" ")[::2]
        kept = sorted((r.doc_id for r in x.collect()), key=str)
        gone = {24}
        assert kept == sorted((i for i, *_ in docs if i not in gone), key=str)
        packed = corpus_pipeline.STAGES[-1][1](spark, x, str(tmp_path))
        assert {r.doc_id for r in packed.collect()} == set(kept)
