import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlode.operators import naming
from layerlode.operators.embedders import HashedNgrams, embed_texts


def square(*upper):
    d = np.zeros((4, 4))
    d[np.triu_indices(4, 1)] = upper
    return d + d.T


@pytest.mark.parametrize(
    ("distances", "most", "want"),
    [
        (square(0.05, 0.9, 0.9, 0.9, 0.9, 0.1), 4, 0.9),  # two pairs, then a merge too far
        (square(0.01, 0.02, 0.03, 0.02, 0.03, 0.03), 4, 0.03),  # all four fit
        (square(0.01, 0.02, 0.03, 0.02, 0.03, 0.03), 3, 0.02),  # a fourth would be one too many
        (square(0.0, 0.0, 0.0, 0.0, 0.0, 0.0), 2, 0.0),  # duplicates don't count
        (square(0.5, 0.6, 0.7, 0.6, 0.7, 0.7), 4, 0.5),  # nothing is near
    ],
)
def test_threshold(distances, most, want):
    assert naming.rename_threshold(distances, most) == pytest.approx(want)


def test_complete_linkage_equals_the_definition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    groups = {i: [i] for i in range(30)}
    for step, (a, b, far, size) in enumerate(naming.complete_linkage(d)):
        best = min(max(d[i, j] for i in groups[p] for j in groups[q]) for p in groups for q in groups if p < q)
        assert far == pytest.approx(best) and far == pytest.approx(max(d[i, j] for i in groups[a] for j in groups[b]))
        groups[30 + step] = groups.pop(a) + groups.pop(b)
        assert len(groups[30 + step]) == size


def test_groups_of_alike_names():
    x = np.array([[1, 0, 0], [0, 1, 0], [1, 0.01, 0], [0, 0, 1], [0, 1, 0.01], [0.5, 0.5, 0.5]])
    assert naming.rename_groups_of(x).tolist() == [0, 1, 0, -1, 1, -1]
    assert naming.rename_groups_of(x[:1]).tolist() == [-1] and naming.rename_groups_of(np.zeros((0, 3))).tolist() == []


REPLIES = [
    ('{"topic_name": "plain", "topic_specificity": 0.4}', "plain"),
    ('Well: {"topic_name": "in text", "topic_specificity": 0.4} and {"topic_name": "later", "topic_specificity": 1}', "in text"),
    ('{\n "topic_name": "lines",\n "topic_specificity": 0.4\n}', "lines"),
    (r'{"topic_name": "a \alpha b", "topic_specificity": 0.4}', r"a \alpha b"),
    (r'{"topic_name": "say \"x\" \\ \d", "topic_specificity": 0.4}', r'say "x" \ \d'),
    ('{"topic_name": "no specificity"}', None),
    ("nothing", None),
    (None, None),
]


def test_replies_are_read(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    got = {r["i"]: r["name"] for r in df.select("i", naming.parsed_field(F.col("reply"), "topic_name").alias("name")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(REPLIES)}


def test_renamed_lists(spark):
    old = ["a", "b"]
    cases = [
        ({"1. a": "x", "2. b": "y"}, ["x", "y"]), ({"1.": "x", "2. b": "y"}, ["x", "y"]), ({"1. a": "x", "2. zz": "y"}, ["x", "b"]), ({"1. a": "x"}, None), ({"1. a": "x", "2. b": "y", "3.": "z"}, None),
    ]
    rows = [(i, json.dumps({"new_topic_name_mapping": m, "topic_specificities": [1]}), old) for i, (m, _) in enumerate(cases)] + [(9, "none", old)]
    df = spark.createDataFrame(rows, "i int, reply string, old array<string>")
    got = {r["i"]: r["n"] for r in df.select("i", naming.renamed(F.col("reply"), F.col("old")).alias("n")).collect()}
    assert got == {**{i: w for i, (_, w) in enumerate(cases)}, 9: None}


class Faulty:
    """Fails the first time it sees a batch, always on some prompts, and never on others."""

    def __init__(self):
        self.seen = set()

    def reply(self, prompts):
        if "bad" in prompts:
            raise RuntimeError("no")
        if tuple(prompts) not in self.seen:
            self.seen.add(tuple(prompts))
            raise RuntimeError("again")
        return [p.upper() for p in prompts]


def test_asking_again():
    quick = lambda i: 0.0
    assert naming.ask(Faulty(), ["a", "b"], wait=quick) == [("A", None), ("B", None)]
    mixed = naming.ask(Faulty(), ["a", "bad", "c"], wait=quick)
    assert [r for r, _ in mixed] == ["A", "", "C"] and "no" in mixed[1][1]

    class Stop:
        def reply(self, prompts):
            raise naming.FailFast("key")

    with pytest.raises(naming.FailFast):
        naming.ask(Stop(), ["a"], wait=quick)
    assert naming.connected(naming.TemplateNamer()).startswith("{") and naming.connected(Faulty()).startswith("<error>")


def test_renames_are_applied_and_repeats_counted(spark):
    names = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (0, 2, "a"), (1, 0, "b")], "layer int, cluster int, name string")
    assert [(r["layer"], r["name"], r["n"]) for r in naming.repeated_names(names).collect()] == [(0, "a", 3)]
    renames = spark.createDataFrame([(0, [0, 2], ["x", ""]), (1, [0], None)], "layer int, clusters array<int>, new_names array<string>")
    assert {tuple(r) for r in naming.apply_renames(names, renames).collect()} == {(0, 0, "x"), (0, 1, "a"), (0, 2, "a"), (1, 0, "b")}


def test_chunks_hold_at_most_twelve(spark):
    groups = spark.createDataFrame([(0, g, c) for g, n in ((0, 30), (1, 2)) for c in range(n)], "layer int, group_id int, cluster int")
    rows = naming.chunked_groups(groups).collect()
    assert sorted((r["group_id"], r["chunk"], r["position"], r["cluster"]) for r in rows) == sorted((g, c // 12, c % 12 + 1, c) for g, n in ((0, 30), (1, 2)) for c in range(n))


def test_offline_embedder_puts_like_names_together(spark):
    a, b, c = HashedNgrams().encode(["machine learning models", "machine learning model", "medieval pottery"])
    assert a @ b > 0.8 > 0.3 > a @ c and np.isclose(np.linalg.norm(a), 1)
    df = spark.createDataFrame([(1, "x y z"), (2, None), (3, ""), (4, "x y z")], "id int, text string")
    got = {r["id"]: r["vector"] for r in embed_texts(df, ["id"]).collect()}
    assert got[1] == got[4] and got[2] == got[3] and len(got) == 4


async def _later(prompt):
    return prompt + "!"


def test_functions_and_bulk_services_as_namers():
    assert naming.CallableNamer(str.upper).reply(["a", "b"]) == ["A", "B"]
    assert naming.CallableNamer(_later, 2).reply(["a", "b", "c"]) == ["a!", "b!", "c!"]
    looks = iter(["waiting", "done"])
    bulk = naming.BatchNamer(lambda p: p, lambda t: next(looks), lambda t: [t[0], None], poll=0)
    assert bulk.reply(["x", "y"]) == ["x", ""]
    gone = []
    slow = naming.BatchNamer(lambda p: 7, lambda t: "waiting", lambda t: [], gone.append, poll=0, timeout=-1)
    with pytest.raises(TimeoutError):
        slow.reply(["x"])
    assert gone == [7]
