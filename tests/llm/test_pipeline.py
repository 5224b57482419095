"""The corpus pipeline against brute force, stage by stage and whole, on odd rows and on an empty table."""

from collections import Counter

import corpus_pipeline
from ridgeline.llm import mixing, quality_classifier
from tests.llm.test_operators import brute_near_groups, brute_secrets, check_packing


def written(tmp_path, documents, labels):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path, documents, rows, labels):
    sf_dir = written(tmp_path, documents, labels)
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        made.append([tuple(r) for r in docs.collect()])
    good, alone, clean, mixed = made
    scores = quality_classifier.classify(documents, labels).collect()
    assert Counter(r[0] for r in good) == Counter(r.doc_id for r in scores if r.score >= 0.5)
    assert len(alone) == len(brute_near_groups(good)) and set(alone) <= set(good)
    assert Counter(r[0] for r in clean) == Counter(r[0] for r in alone) and not any(brute_secrets(r[1]) for r in clean)
    kept = {r[0]: r[1] for r in alone}
    assert all(r[1] == kept[r[0]] for r in clean if not brute_secrets(kept[r[0]]))
    copies = mixing.mix(spark.read.parquet(str(tmp_path / "stage2"))).collect()
    assert Counter(r[0] for r in mixed) == Counter({r.doc_id: r.copies for r in copies if r.copies})
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), mixed, 4096)


def test_pipeline_of_nothing(spark, tmp_path, empty, labels):
    assert corpus_pipeline.run(spark, written(tmp_path, empty, labels)).count() == 0
