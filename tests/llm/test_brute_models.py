"""The two fitted operators against plain versions: features by loops, every split against all others, isotonic by its
min-max formula, whole queries row by row."""

import math
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest

from layerlode.llm.html import extract_text, fit_extraction, nodes_of, parse, weak_labels
from layerlode.llm.toxicity import SECOND_PERSON, Featuriser, build_lexicon, fit_toxicity, toxicity_scores
from tests.llm.test_html import page
from tests.llm.test_toxicity import corpus


def walk(tree, row):
    i = 0
    while tree.feature[i] >= 0:
        i = 2 * i + 1 if row[tree.feature[i]] <= tree.cut[i] else 2 * i + 2
    return i


def margin(model, row):
    return model.base + sum(tree.value[walk(tree, row)] for tree in model.grown)


def assert_trees_are_greedy(model, x, y, trees=None):
    """Each leaf has the value, and each split the gain, that the best of all splits at quantiles has."""
    n = len(y)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    assert model.base == pytest.approx(math.log(share / (1 - share)))
    cuts = [sorted({sorted(c)[math.floor(q * (n - 1) + 1e-9)] for q in np.linspace(0, 1, model.bins + 1)[1:-1]}) for c in x.T]
    score = np.full(n, model.base)
    for tree in model.grown[:trees]:
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        nodes = {0: np.arange(n)}
        for i in range(len(tree.feature)):
            if i not in nodes:
                continue
            at = nodes[i]
            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + model.penalty)
            assert tree.value[i] == pytest.approx(model.rate * g[at].sum() / (h[at].sum() + model.penalty), abs=1e-9)
            best = 0.0
            if i < len(tree.feature) // 2:
                for f in range(x.shape[1]):
                    for c in cuts[f]:
                        low = x[at, f] <= c
                        if min(low.sum(), (~low).sum()) >= model.least_rows:
                            best = max(best, worth(at[low]) + worth(at[~low]) - worth(at))
            if tree.feature[i] < 0:
                assert best <= 1e-8
                score[at] += tree.value[i]
                continue
            low = x[at, tree.feature[i]] <= tree.cut[i]
            assert worth(at[low]) + worth(at[~low]) - worth(at) == pytest.approx(best, abs=1e-8)
            nodes[2 * i + 1], nodes[2 * i + 2] = at[low], at[~low]


# ---- toxicity ----

PLAIN = dict(zip("013457@$!", "oieastasi", strict=True)) | {"*": ""}


def weigh(words, prefixes, word):
    if word in words:
        return words[word], "word"
    own = [prefixes[word[:k]] for k in range(4, 9) if word[:k] in prefixes]
    return (max(own), "prefix") if own else (0.0, "")


def toxic_features(text, words, prefixes):
    tokens = re.findall(r"[^\W_][\w'@$*!]*", text)
    n, chars = max(len(tokens), 1), max(len(text), 1)
    hits, yous = {}, []
    for i, t in enumerate(tokens):
        low = t.lower()
        w, kind = weigh(words, prefixes, low)
        if not kind and not low.isalpha():
            w, kind = weigh(words, prefixes, "".join(PLAIN.get(c, c) for c in low))
            kind = kind and "masked"
        if kind:
            hits[i] = (w, kind)
        elif low in SECOND_PERSON:
            yous.append(i)
    kinds = Counter(k for _, k in hits.values())
    window = max((sum(w for j, (w, _) in hits.items() if i <= j < i + 50) for i in hits), default=0.0)
    near = sum(any(abs(i - j) <= 8 for j in yous) for i in hits)
    ascii_ = [c for c in text if c.isascii()]
    upper, letters = sum("A" <= c <= "Z" for c in ascii_), max(sum(c.isalpha() for c in ascii_), 1)
    marks, digits = sum(c.isprintable() and not c.isalnum() and c != " " for c in ascii_), sum(c.isdigit() for c in ascii_)
    odd = len(re.findall(r"[^\W\d_][\d@$*!]+[^\W\d_]", text)) if any(c in "*@$!" or c.isdigit() for c in ascii_) else 0
    spaced, repeats = len(re.findall(r"(?:\b[^\W\d_]\b[ .\-_*]){3,}", text)), len(re.findall(r"([^\W\d_])\1{2,}", text))
    return [
        sum(w for w, _ in hits.values()) / n, len(hits) / n, window, kinds["word"] / n, kinds["prefix"] / n, near / n, len(yous) / n, kinds["masked"] / n, odd / n, spaced / n, repeats / n,
        upper / letters, sum(t.isupper() for t in tokens) / n, text.count("!") / chars, text.count("?") / chars, marks / chars, digits / chars, math.log(1 + len(tokens)), len({tokens[i].lower() for i in hits}),
    ]


def lexicon_by_definition(texts, toxic):
    kinds = dict(zip(texts, toxic, strict=True))
    own = {t: {w.lower() for w in re.findall(r"[^\W_][\w'@$*!]*", t)} for t in kinds}
    own = {t: ws | {"^" + w[:k] for w in ws for k in range(4, 9) if len(w) > k} for t, ws in own.items()}
    bad, good = [own[t] for t in kinds if kinds[t]], [own[t] for t in kinds if not kinds[t]]
    tried = {w for s in bad for w in s if sum(w in x for x in bad) >= 4}
    found = []
    for w in tried:
        a, b = sum(w in s for s in bad), sum(w in s for s in good)
        odds = math.log((a + 0.5) / (len(bad) - a + 0.5) * (len(good) - b + 0.5) / (b + 0.5))
        share = (a + b) / (len(bad) + len(good))
        cells = [(a, len(bad) * share), (len(bad) - a, len(bad) * (1 - share)), (b, len(good) * share), (len(good) - b, len(good) * (1 - share))]
        evidence = sum(2 * o * math.log(o / e) for o, e in cells if o)
        if odds >= 1.5 and evidence >= 2 * math.log(len(tried) / 0.05):
            found.append((-evidence, -len(w), w, odds))
    words, prefixes = {}, {}
    for _, _, w, odds in sorted(found, key=lambda t: (round(t[0], 9), t[1], t[2])):
        name = w.lstrip("^")
        covered = any(name.startswith(p) for p in prefixes)
        if not covered and (w == name or not any(x.startswith(name) for x in [*words, *prefixes])):
            (words if w == name else prefixes)[name] = odds
    return words, prefixes


@pytest.fixture(scope="module")
def toxic_fixture(spark):
    texts, toxic = corpus(260, 11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    return texts, toxic, docs, labels


def test_toxicity_equals_its_plain_version(spark, toxic_fixture):
    import xxhash

    texts, toxic, docs, labels = toxic_fixture
    model = fit_toxicity(docs, labels)
    order = sorted(range(len(texts)), key=lambda i: xxhash.xxh64_intdigest(str(i)))
    parts = [[i for k, i in enumerate(order) if k % 5 in own] for own in ((0, 2), (1, 3), (4,))]
    books = [lexicon_by_definition([texts[i] for i in p], [toxic[i] for i in p]) for p in parts[:2]]
    rows = np.array([toxic_features(texts[i], *books[1 - k]) for k in (0, 1) for i in parts[k]])
    assert_trees_are_greedy(model.trees, rows, np.array([toxic[i] for k in (0, 1) for i in parts[k]], dtype=float), 6)
    words, prefixes = lexicon_by_definition([texts[i] for i in parts[0] + parts[1]], [toxic[i] for i in parts[0] + parts[1]])
    assert words == pytest.approx(model.lexicon.words) and prefixes == pytest.approx(model.lexicon.prefixes)
    # Isotonic: at each calibrating score the largest least mean of runs that end at or after it.
    held = sorted((margin(model.trees, toxic_features(texts[i], words, prefixes)), toxic[i]) for i in parts[2])
    scores = sorted({round(s, 9) for s, _ in held})
    groups = [[y for s, y in held if round(s, 9) == v] for v in scores]
    mean = lambda i, j: sum(map(sum, groups[i : j + 1])) / sum(map(len, groups[i : j + 1]))
    steps = [max(min(mean(i, k) for k in range(j, len(groups))) for i in range(j + 1)) for j in range(len(groups))]
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    for i, text in enumerate(texts):
        s = margin(model.trees, toxic_features(text, words, prefixes))
        want = float(np.interp(s, scores, steps))
        assert got[i]["toxic_probability"] == pytest.approx(want, abs=1e-6) and got[i]["is_toxic"] == (got[i]["toxic_probability"] >= 0.5)


def test_toxic_features_of_odd_texts():
    lexicon = build_lexicon(*corpus(400, 3))
    own = Featuriser(lexicon)
    texts = ["", "   ", "éÀß ñ 1a2 f0ulw0rd you FOULWORD!!! f o u l w o r d sooo", "you " * 60 + "vilething " * 70, "_a_ don't @x $5 ** ~`|", "v1lething nastyones ihr du NASTYONE", "\U0001f600 a.b-c_d*e"]
    for text in texts + corpus(40, 9)[0]:
        assert own.features(text) == pytest.approx(toxic_features(text, lexicon.words, lexicon.prefixes), abs=1e-9)


# ---- pages ----

GROUPS = {t: k for k, tags in enumerate(("p", "a", "li ul ol dl dd dt", "h1 h2 h3 h4 h5 h6", "table tbody thead tr td th", "pre code blockquote", "b i em strong span small u font"), 1) for t in tags.split()}
INLINE = "a abbr b bdi bdo cite code dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split()


def page_features(dom, weights):
    n = len(dom.tag)
    kids = [[j for j in range(n) if dom.parent[j] == i] for i in range(n)]
    below = [[j for j in range(i, dom.end[i])] for i in range(n)]
    texts = [[t for i, t in dom.texts if i == j and not t.isspace()] for j in range(n)]
    chars = [sum(map(len, t)) for t in texts]
    words = [sum(x.count(" ") + 1 for x in t) for t in texts]
    marks = [sum(len(re.findall(r"[.,;:!?]", x)) for x in t) for t in texts]
    linked = [any(dom.tag[a] == "a" for a in range(i + 1) if i < dom.end[a]) for i in range(n)]
    total = lambda values, i: sum(values[j] for j in below[i])
    attribute = [sum(weights.get(t, 0.0) for t in own) for own in dom.tokens]
    out = []
    for i in range(n):
        c, w, up = total(chars, i), total(words, i), dom.parent[i]
        row = kids[up] if up >= 0 else [i]
        k = row.index(i)
        mean = (total(chars, up) - chars[up]) / len(row) if up >= 0 else c
        side = lambda j: math.log1p(total(chars, row[j])) if 0 <= j < len(row) else 0.0
        out.append([
            math.log1p(chars[i]), math.log1p(c), math.log1p(w), math.log1p(len(below[i])), c / len(below[i]), sum(chars[j] for j in below[i] if linked[j]) / max(c, 1), total(marks, i) / max(c, 1), dom.depth[i],
            math.log1p(len(kids[i])), k / max(len(row) - 1, 1), math.log1p(len(row)), side(k - 1), side(k + 1), math.log1p(max(mean, 0)), c / max(total(chars, max(up, 0)), 1), c / max(total(chars, 0), 1),
            sum(chars[:i]) / max(total(chars, 0), 1), attribute[i], sum(attribute[a] for a in range(i + 1) if i < dom.end[a]), c / max(w, 1), *[float(GROUPS.get(dom.tag[i], 0) == g) for g in range(8)],
        ])
    return np.array(out), words


def chosen(dom, odds, words):
    """The best consistent choice by recursion."""
    gain = [o * (1 + math.log1p(w)) for o, w in zip(odds, words, strict=True)]
    kids = [[j for j in range(len(gain)) if dom.parent[j] == i] for i in range(len(gain))]

    def best(i):
        parts = [best(j) for j in kids[i]]
        inner, whole = sum(v for v, _ in parts), sum(gain[i : dom.end[i]])
        if whole > 0 and whole >= inner - 1e-9:
            return whole, set(range(i, dom.end[i]))
        return inner, set().union(*[s for _, s in parts])

    return best(0)[1]


def plain_text(dom, keep):
    lines, last = [], None
    for i, t in dom.texts:
        if i not in keep:
            continue
        at = i
        while dom.tag[at] in INLINE:
            at = dom.parent[at]
        if t == "\n":
            lines.append([])
            last = None
        elif last == at:
            lines[-1].append(t)
        else:
            lines.append([t])
            last = at
    out = [re.sub(r"\s+", " ", unescape("".join(x))).strip() for x in lines]
    return "\n".join(x for x in out if x)


def test_pages_equal_their_plain_version(spark):
    pages = [(i, "u", page(i, tags=i % 3 > 0)[0]) for i in range(40)] + [(40, "u", "<p>a<b class='x y'>b, c</b><a href=q>d</a><br>e<table><tr><td>f<td>g</table>"), (41, "u", ""), (42, "u", "plain &amp; text")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    model = fit_extraction(df)
    got = {r["page_id"]: r for r in extract_text(df).collect()}
    for i, _, html in pages:
        dom = parse(html)
        x, words = page_features(dom, model.weights)
        assert np.allclose(nodes_of([dom], model.weights).features, x, atol=1e-9)
        keep = chosen(dom, [margin(model.trees, row) for row in x], words)
        assert (got[i]["text"], got[i]["n_nodes"], got[i]["n_content"]) == (plain_text(dom, keep), len(dom.tag) - 1, len(keep - {0}))


def test_page_model_is_fitted_as_it_says():
    from layerlode.llm.html import fit_pages

    model = fit_pages([page(i)[0] for i in range(24)])
    known = [(d, weak_labels(d)) for d in (parse(page(i)[0]) for i in range(24))]
    seen = {k: [set(t) for d, y in known[::2] for t, v in zip(d.tokens, y, strict=True) if v == k] for k in (0, 1)}
    for token in {t for k in seen for s in seen[k] for t in s}:
        a, b = (sum(token in s for s in seen[k]) for k in (1, 0))
        if a + b >= 3:
            assert model.weights[token] == pytest.approx(math.log((a + 0.5) / (len(seen[1]) + 1)) - math.log((b + 0.5) / (len(seen[0]) + 1)))
        else:
            assert token not in model.weights
    x, y = np.concatenate([page_features(d, model.weights)[0] for d, _ in known[1::2]]), np.concatenate([y for _, y in known[1::2]])
    assert_trees_are_greedy(model.trees, x[y >= 0], y[y >= 0].astype(float), 4)
