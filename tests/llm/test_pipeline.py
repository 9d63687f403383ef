"""The pipeline stage by stage against plain Python over its input."""

from collections import Counter

import pytest

import corpus_pipeline
from reviewlens.llm import quality, queries
from reviewlens.llm.simhash import fingerprint
from reviewlens.sources import files

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.collect()
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, FOLDER)
        result.write.parquet(path := str(tmp_path / str(n)))
        result = spark.read.parquet(path)
        after = result.collect()
        if name != "bpe encoding":
            assert result.columns == docs.columns
        if name == "quality classifier":
            good = model.score(quality.np.array([quality.features(r["text"].encode()) for r in before])) >= 0.5
            expected = [r["doc_id"] for r, keep in zip(before, good) if keep]
        elif name == "exact dedup":
            expected = list({r["text"]: r["doc_id"] for r in sorted(before, key=lambda r: r["doc_id"])}.values())
        elif name == "simhash near-dedup":
            prints = [fingerprint(r["text"].encode()) & (1 << 64) - 1 for r in before]
            label = [r["doc_id"] for r in before]
            near = [[m for m, q in enumerate(prints) if (p ^ q).bit_count() <= 4] for p in prints]
            for _ in before:
                label = [min(label[m] for m in ms) for ms in near]
            expected = sorted(set(label))
        elif name == "mixing sources":
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
            words = [sum(len(r["text"].split()) for r in rows) for rows in (before, after)]
            assert 1.3 * words[0] < words[1] < 1.7 * words[0]
            expected = [r["doc_id"] for r in after]
        else:
            vocabulary = queries.vocabulary()
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(vocabulary.encode(texts[r["doc_id"]]) == r["ids"] for r in after)
            assert all(r["n_tokens"] == len(r["ids"]) for r in after)
            expected = [r["doc_id"] for r in before]
        assert sorted(r["doc_id"] for r in after) == sorted(expected), name
        docs, before = result, after


def test_nothing_is_left_but_the_result(spark, monkeypatch):
    before = files.intermediates()
    result = corpus_pipeline.run(spark, FOLDER)
    left = [path for path in files.intermediates() if path not in before]
    assert len(left) == 1 and result.count() > 0 and all(left[0].rsplit("/", 1)[1] in file for file in result.inputFiles())

    def fails(spark, docs, folder):
        raise ArithmeticError

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("fails", fails)])
    with pytest.raises(ArithmeticError):
        corpus_pipeline.run(spark, FOLDER)
    assert [path for path in files.intermediates() if path not in before] == left
