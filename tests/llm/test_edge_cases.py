"""Every operator and stage on nulls, empty, blank and very long texts, repeated rows, empty tables and clashing columns."""

from collections import Counter

import pytest

from layerlode.llm.bpe import bpe_decode, bpe_encode
from layerlode.llm.kdtree import kd_tree_shards
from layerlode.llm.minhash import drop_near_duplicates, near_duplicate_groups
from layerlode.llm.mixing import mix_documents, sample_documents
from layerlode.llm.suffix_tree import suffix_tree_scores
from layerlode.llm.toxicity import drop_toxic, toxicity_scores

from tests.llm.conftest import edge_rows


def test_suffix_tree(spark, edges, nothing):
    rows = suffix_tree_scores(edges).collect()
    assert len(rows) == edges.count()
    for r in rows:
        if r["n_bytes"] == 0:
            assert r["log2_prob"] == 0 and r["bits_per_byte"] is None
        else:
            assert r["log2_prob"] < 0 and r["bits_per_byte"] > 0
    assert len({r["log2_prob"] for r in rows if r["doc_id"] == 3}) == 1
    assert suffix_tree_scores(nothing).count() == 0


def test_kd_tree(edges, nothing):
    rows = kd_tree_shards(edges, target_bytes=500).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in edge_rows())
    assert len({r["shard_path"] for r in rows if r["doc_id"] == 3}) == 1
    assert {r["bytes"] for r in rows if r["doc_id"] in (20, 21)} == {0}
    assert kd_tree_shards(nothing).count() == 0


def test_mixing(edges, nothing, topics):
    rows = mix_documents(edges, topics).collect()
    kept = Counter(r["doc_id"] for r in rows)
    assert all(n == Counter(r[0] for r in edge_rows())[i] for i, n in kept.items() if i is not None)
    assert all(0 < r["probability"] <= 1 for r in rows)
    sampled = sample_documents(edges, topics)
    assert sampled.columns == edges.columns
    assert Counter(r["doc_id"] for r in sampled.collect()) == kept
    assert mix_documents(nothing, topics).count() == 0
    assert mix_documents(edges, topics.limit(0)).count() >= 0


def test_toxicity(edges, nothing, labels):
    rows = toxicity_scores(edges, labels).collect()
    assert len(rows) == edges.count()
    assert all(r["toxic_probability"] is None and not r["is_toxic"] for r in rows if r["doc_id"] == 20)
    assert drop_toxic(edges, labels).columns == edges.columns
    assert toxicity_scores(nothing, labels).count() == 0
    none = toxicity_scores(edges, labels.limit(0)).collect()
    assert len(none) == edges.count() and all(r["toxic_probability"] is None for r in none)
    assert drop_toxic(edges, labels.limit(0)).count() == edges.count()


def test_minhash(edges, nothing):
    groups = near_duplicate_groups(edges).collect()
    assert {(r["group_id"], r["n_docs"], tuple(r["doc_ids"])) for r in groups} == {(3, 5, (3, 26))}
    kept = drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    want = Counter(r[0] for r in edge_rows())
    want[3], want[26] = 1, 0
    assert Counter(r["doc_id"] for r in kept.collect()) == +want
    assert near_duplicate_groups(nothing).count() == 0 and drop_near_duplicates(nothing).count() == 0


def test_bpe(edges, nothing):
    encoded = bpe_encode(edges)
    rows = encoded.collect()
    assert len(rows) == edges.count()
    assert all(r["round_trip"] for r in rows if r["token_ids"] is not None)
    assert all(r["n_tokens"] == 0 and r["token_ids"] is None for r in rows if r["doc_id"] == 20)
    assert all(r["token_ids"] == [] for r in rows if r["doc_id"] == 21)
    texts = Counter((r["doc_id"], r["text"]) for r in bpe_decode(encoded).collect())
    assert texts == Counter((r[0], r[1]) for r in edge_rows())
    assert bpe_encode(nothing).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages(spark, edges, nothing, tmp_path, stage, labels, topics):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    topics.write.parquet(f"{tmp_path}/embeddings.parquet")
    name, run = pipeline.STAGES[stage]
    out = run(spark, edges, str(tmp_path))
    assert out.count() <= edges.count() and run(spark, nothing, str(tmp_path)).count() == 0
    if stage < len(pipeline.STAGES) - 1:
        assert out.columns == edges.columns
    else:
        assert "doc_id" in out.columns
