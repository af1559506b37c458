import os

import numpy as np
import pytest

from layerlode.llm import bpe
from tests.llm.conftest import prose

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="the vocabulary files aren't here")

TEXTS = ["", " ", "Hello, world! It's 12:30.", "héé ñandú ÜBER straße 你好世界 😀😀", "a" * 5000, "ab" * 3000 + " \n\n\t x", "<|endoftext|> is text", "\u0000\u0001 odd", "don't WE'LL they've", prose(1, 400), "x" * 70 + "ÿ" * 70, "https://a.b/c?d=e&f=%20"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})


def naive(piece, ranks):
    """Merging by the definition: the leftmost pair of least rank, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_tokens_equal_another_implementation(reference):
    own = bpe.encoder()
    for t in TEXTS:
        assert own.encode(t) == reference.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t


def test_fragments_equal_whole_words_merged_by_the_definition():
    own = bpe.encoder()
    for w in ["tokenization", "straße", "ééàü", "zqxjkv", "aAaAbBb", "😀x", "ñandúes", "!!??--", "x" * 60]:
        assert np.frombuffer(own.word(w), dtype="<i4").tolist() == naive(w.encode(), own.ranks)


def test_no_token_crosses_a_forced_boundary():
    own = bpe.encoder()
    assert 0 < own.inside.sum() < own.inside.size
    for token in list(own.ranks)[:5000]:
        assert all(own.inside[a, b] for a, b in zip(token, token[1:], strict=False))


def test_query_equals_one_text_at_a_time(spark, reference):
    rows = [*enumerate(TEXTS), (99, None)]
    out = bpe.bpe_encode(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for r in out.collect():
        if r["doc_id"] == 99:
            assert r["token_ids"] is None and r["round_trip"] is None
        else:
            text = TEXTS[r["doc_id"]]
            assert r["token_ids"] == reference.encode_ordinary(text) and r["round_trip"] and r["n_bytes"] == len(text.encode())
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(out).collect()}
    assert back == dict(rows)


def test_decoding_odd_lists(spark):
    df = spark.createDataFrame([(1, [None, 36]), (2, []), (3, [188])], "doc_id bigint, token_ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.bpe_decode(df).collect()} == {1: bpe.encoder().decode([36]), 2: "", 3: bpe.encoder().decode([188])}
