import random

import numpy as np

from layerlode.llm.boosting import Boosted, Isotonic
from layerlode.llm.toxicity import FEATURES, Featuriser, Lexicon, build_lexicon, drop_toxic, fit_texts, toxicity_scores
from tests.llm.conftest import prose

INSULTS = ["foulword", "nastyone", "vilething", "creepish"]


def corpus(n, seed=0):
    r = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        text = prose(seed * 10_000 + i, r.randint(20, 120))
        bad = r.random() < 0.2
        if bad:
            words = text.split()
            for _ in range(r.randint(3, 6)):
                w = r.choice(INSULTS)
                words.insert(r.randrange(len(words)), r.choice([w, "you " + w, w.upper() + "!!", w.replace("o", "0").replace("i", "1")]))
            text = " ".join(words)
        texts.append(text)
        toxic.append(int(bad))
    return texts, np.array(toxic)


def test_held_out_accuracy():
    model = fit_texts(*corpus(800, 1))
    texts, toxic = corpus(400, 2)
    p = model.probabilities(Featuriser(model.lexicon).matrix(texts))
    assert (p[toxic == 1] >= 0.5).mean() >= 0.9 and (p[toxic == 0] >= 0.5).mean() <= 0.02


def test_lexicon_finds_words_and_leaves_common_ones():
    lexicon = build_lexicon(*corpus(800, 3))
    assert all(lexicon.weigh(w)[1] for w in INSULTS)
    clean = prose(5, 300).lower().split()
    assert sum(bool(lexicon.weigh(w)[1]) for w in clean) <= 3


def test_query_equals_scoring_texts_one_by_one(spark):
    texts, toxic = corpus(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    from layerlode.llm.toxicity import fit_toxicity

    model = fit_toxicity(docs, labels)
    one = Featuriser(model.lexicon)
    for i, t in enumerate(texts):
        p = float(model.probabilities(one.matrix([t]))[0])
        assert abs(rows[i]["toxic_probability"] - p) < 1e-9 and rows[i]["is_toxic"] == (p >= 0.5)
    assert {r["doc_id"] for r in drop_toxic(docs, labels).collect()} == {i for i, r in rows.items() if not r["is_toxic"]}


def test_features_see_what_they_name():
    f = Featuriser(Lexicon({"foul": 3.0}, {"vilet": 2.0}))
    get = lambda t: dict(zip(FEATURES, f.features(t), strict=True))
    assert get("you foul thing")["near_you_rate"] > 0 and get("foul thing")["near_you_rate"] == 0
    assert get("such a f0ul one")["masked_hit_rate"] > 0 and get("viletones all")["prefix_rate"] > 0
    assert get("ALL LOUD")["capitals"] == 1 and get("f o u l it")["spaced_rate"] > 0 and get("sooo")["repeat_rate"] > 0


def test_isotonic_is_the_best_step_fit():
    rng = np.random.default_rng(1)
    x, y = np.sort(rng.normal(size=60)), (rng.random(60) < 0.5).astype(float)
    fit = Isotonic().fit(x, y).predict(x)
    assert (np.diff(fit) >= -1e-12).all()
    lo = [max(min(y[i : k + 1].mean() for k in range(j, 60)) for i in range(j + 1)) for j in range(60)]
    assert np.allclose(fit, lo)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Boosted().fit(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
