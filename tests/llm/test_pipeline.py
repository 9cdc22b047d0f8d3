"""The pipeline's stages, each against what its operator says about the stage's own input."""

from __future__ import annotations

import brute
import corpus_pipeline
from corpuscope.llm import toxicity
from corpuscope.llm.base import read

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read(spark, FOLDER, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name == "toxicity":
            model = toxicity.fit(docs, read(spark, FOLDER, "labels"))
            assert set(ids) == {i for i, t in before.items() if model.score(t) < 0.5}
        elif name == "line_dedup":
            want = brute.line_windows(sorted(before.items()))
            assert {r["doc_id"]: r["text"] for r in rows} == {i: w[0] for i, w in want.items() if not w[2] or w[0].strip()}
        elif name == "near_dedup":
            assert set(ids) == set(brute.alike(list(before), list(before.values())).values())
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in read(spark, FOLDER, "benchmark").collect()]
            windows = {tuple(w[i : i + min(10, len(w))]) for _, t in items if (w := brute.words7(t)) for i in range(max(1, len(w) - 9))}
            hit = {i for i, t in before.items() if any(tuple(w[j : j + 10]) in windows for w in [brute.words7(t)] for j in range(len(w)))}
            assert set(ids) == set(before) - hit
        else:
            assert out.columns == ["doc_id", "n_ids", "ids"] and set(ids) == set(before)
        if "text" in out.columns:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            before = {r["doc_id"]: r["text"] for r in rows}
        docs = out


def test_empty_documents(spark):
    docs = read(spark, FOLDER, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, equal ids and clashing columns: no stage fails, clean texts stay, and of equal texts one does."""
    long = " ".join(f"w{i % 997}x{i // 997}" for i in range(30_000))
    clean = [f"a plain text number {i} about {' '.join(f'thing{i}{j}' for j in range(12))}" for i in range(6)]
    odd = [(None, None), (None, ""), (9_000, ""), (9_001, long), (9_002, "one"), (9_003, "two words"), (9_004, clean[0]), (9_004, clean[0]), (9_004, clean[1]), (9_005, clean[2]), (9_006, clean[2]), (None, clean[3]),
           (9_007, clean[4]), (9_008, clean[4] + " indeed"), (9_009, clean[5]), (9_010, "\n".join([long] * 2))]
    given = read(spark, FOLDER, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    extra = spark.createDataFrame([(i, t, None, "s", None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = given.unionByName(extra).selectExpr("*", "'x' AS _key", "1 AS score", "2 AS fp", "'y' AS shingle").repartition(5)
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "encode":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        else:
            assert docs.columns == ["doc_id", "n_ids", "ids"] and docs.count() == len(texts)
        if name == "near_dedup":
            # equal texts and near copies leave one, the one of the smallest id; a null id comes first
            left = [i for i, t in texts if t in clean or (t or "").endswith(" indeed")]
            assert sorted(left, key=lambda i: (i is not None, i)) == [None, 9_004, 9_004, 9_005, 9_007, 9_009]
            assert sum(not (t or "").strip() for _, t in texts) == 1
    assert {9_001, 9_002, 9_003} <= {i for i, _ in texts} and len(texts) > 100
