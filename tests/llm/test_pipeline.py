import random

import pytest

from layerlode.llm import bpe, mixing, toxicity
from layerlode.llm.bpe import encoder
from tests.llm.conftest import prose
from tests.llm.test_minhash import brute
from tests.llm.test_toxicity import corpus

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts, toxic = corpus(260, 9)
    r = random.Random(4)
    texts += texts[:20] + [t.replace(" ", "  ", 3) for t in texts[20:30]]
    toxic = [*toxic, *toxic[:30]]
    docs = [(i, t, r.choice(["en", "de"]), f"src{r.choice([0, 0, 0, 1, 2])}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, [1.0], i % 3) for i in range(0, 290, 2)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_rows_equal_the_stages_done_by_hand(spark, folder):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    model = toxicity.fit_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    p = model.probabilities(toxicity.Featuriser(model.lexicon).matrix([docs[i]["text"] for i in sorted(docs)]))
    kept = [i for i, x in zip(sorted(docs), p, strict=True) if x < toxicity.THRESHOLD]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sum(labels[i] for i in kept) <= 0.1 * sum(labels.values()) and sum(not labels[i] for i in kept) >= 0.97 * sum(not y for y in labels.values())
    groups = brute([docs[i]["text"] for i in kept], 0.5)
    gone = {kept[k] for g in groups for k in g[1:]}
    kept = [i for i in kept if i not in gone]
    left = spark.createDataFrame([tuple(docs[i]) for i in kept], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = {r["doc_id"] for r in mixing.mix_documents(left, spark.read.parquet(f"{folder}/embeddings.parquet")).collect()}
    want = {i: encoder().encode(docs[i]["text"]) for i in mixed}
    got = {r["doc_id"]: r["token_ids"] for r in pipeline.run(spark, folder).collect()}
    assert got == want and 0 < len(got) < len(docs) and prose(1, 2) and bpe.VOCABULARY


def test_stages_name_the_operators_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "encoding"]
