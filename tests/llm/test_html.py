import random

import numpy as np
from pyspark.sql import functions as F

from layerlode.llm.html import Nodes, decode, extract_batch, extract_text, fit_pages, parse, text_of, weak_labels
from tests.llm.conftest import prose


def page(i, tags=True):
    r = random.Random(i)
    nav = "".join(f"<li><a href='/{k}'>{prose(k, 1)}</a></li>" for k in range(r.randint(4, 9)))
    paragraphs = [prose(1000 * i + k, r.randint(15, 70)) for k in range(r.randint(2, 7))]
    body = "".join(f"<p>{p}" + r.choice(["</p>", ""]) for p in paragraphs)
    main, side, foot = ("article", "nav", "footer") if tags else ("div", "div", "div")
    extra = f"<div class='ad box'>{prose(i, 6)}</div>" if r.random() < 0.7 else ""
    html = f"<!DOCTYPE html><html><head><title>t</title><script>var x='<p>';</script></head><body><{side} class='menu'><ul>{nav}</ul></{side}>{extra}<{main} class='post'><h1>{prose(i, 4)}</h1>{body}</{main}><{foot} class='foot'>&copy; {prose(i + 7, 3)}</{foot}></body></html>"
    return html, "\n".join([prose(i, 4), *paragraphs])


def test_held_out_pages_without_telling_tags():
    model = fit_pages([page(i)[0] for i in range(200)])
    test = [page(i, tags=False) for i in range(500, 600)]
    found = extract_batch(model, [h for h, _ in test])
    assert sum(t == want for (t, _, _), (_, want) in zip(found, test, strict=True)) >= 90


def test_parse_builds_the_tree_that_browsers_do():
    dom = parse("<ul><li>a<li>b</ul><p>c<p>d<br>e<div x=\"a>b\" class='K1 k2'>f</div></zzz><img src=q>tail")
    names = [(t, dom.tag[p] if p >= 0 else None) for t, p in zip(dom.tag, dom.parent, strict=True)]
    assert names == [("", None), ("ul", ""), ("li", "ul"), ("li", "ul"), ("p", ""), ("p", ""), ("div", ""), ("img", "")]
    assert [(dom.tag[i], t) for i, t in dom.texts] == [("li", "a"), ("li", "b"), ("p", "c"), ("p", "d"), ("p", "\n"), ("p", "e"), ("div", "f"), ("", "tail")]
    assert dom.tokens[6] == ("k", "k") and dom.end[1] == 4
    assert text_of(dom, np.ones(8, dtype=bool)).split("\n") == ["a", "b", "c", "d", "e", "f", "tail"]


def test_parse_of_odd_pages_takes_linear_time():
    import time

    began = time.time()
    for odd in ("<a " * 200_000, "<" * 300_000, "<div>" * 100_000, "<!--" * 100_000, "<p 'x" * 100_000 + ">", "<script>" * 50_000, "&amp;" * 100_000):
        parse(odd)
    assert time.time() - began < 30


def test_large_odd_pages_are_extracted_in_linear_time():
    import time

    model = fit_pages([page(i)[0] for i in range(60)])
    n = 100_000
    for odd in ("<div>" * n + "</span>" * n, "<div>" * (2 * n), "<p><button>" + "<div>" * n, "<b>x" * n, "<article>" * n + "x", "<nav>" * n, "<table>" + "<tr><td>" * n, "<ul>" + "<li>x" * n, "<span>" + "<div></span>" * n):
        began = time.time()
        extract_batch(model, [odd])
        assert time.time() - began < 10, odd[:20]


def test_deep_trees_decode_as_flat_ones_do():
    from layerlode.llm.html import _decode_deep

    r = random.Random(2)
    for _ in range(50):
        n = r.randint(1, 40)
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        # document order needs each subtree to be a run: rebuild from a walk
        kids = {i: [j for j in range(n) if parent[j] == i] for i in range(n)}
        order, up, stack = [], [], [(0, -1)]
        while stack:
            at, above = stack.pop()
            up.append(above)
            order.append(at)
            stack += [(k, len(order) - 1) for k in kids[at]]
        depth, end = [0] * n, [i + 1 for i in range(n)]
        for i in range(1, n):
            depth[i] = depth[up[i]] + 1
        for i in range(n - 1, 0, -1):
            end[up[i]] = max(end[up[i]], end[i])
        gains = np.array([r.uniform(-2, 2) for _ in range(n)])
        sums = np.concatenate([[0.0], np.cumsum(gains)])
        whole = sums[np.array(end)] - sums[:-1]
        take = _decode_deep(up, whole.tolist())
        assert all(take[i] for i in range(1, n) if take[up[i]])
        if n <= 10:
            assert abs(gains[take].sum() - brute(up, gains)) < 1e-9


def brute(parent, gains):
    """The best set of subtrees, by trying all antichains of a small tree."""
    n = len(parent)
    below = [{i} for i in range(n)]
    for i in range(n - 1, 0, -1):
        below[parent[i]] |= below[i]
    best = 0.0
    for mask in range(1 << n):
        roots = [i for i in range(n) if mask >> i & 1]
        if any(a != b and b in below[a] for a in roots for b in roots):
            continue
        best = max(best, sum(gains[x] for i in roots for x in below[i]))
    return best


def test_decoding_is_the_best_consistent_choice():
    r = random.Random(6)
    for _ in range(60):
        n = r.randint(1, 9)
        parent = [-1] + [0] * (n - 1)
        for i in range(1, n):  # document order: a new node hangs on the chain of the last one
            chain, at = [], i - 1
            while at >= 0:
                chain.append(at)
                at = parent[at]
            parent[i] = r.choice(chain)
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        end = [i + 1 for i in range(n)]
        for i in range(n - 1, 0, -1):
            end[parent[i]] = max(end[parent[i]], end[i])
        gains = np.array([r.uniform(-2, 2) for _ in range(n)])
        nodes = Nodes([], np.array(parent), np.array(end), np.array(depth), np.zeros((n, 1)), np.zeros(n), np.array([0, n]))
        take = decode(nodes, gains)
        assert all(take[i] for i in range(1, n) if take[parent[i]])
        assert abs(gains[take].sum() - brute(parent, gains)) < 1e-9


def test_query_on_odd_tables(spark):
    rows = [(i, f"http://{i}/", page(i)[0]) for i in range(60)] + [(60, "u", None), (61, None, ""), (None, "u", "plain"), (62, "u", "<p>" + prose(1, 50_000)), (3, "http://3/", page(3)[0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "h": F.lit(1), "n_nodes": F.lit(2), "_hash": F.lit(3)})
    out = extract_text(df).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[60]["text"] is None and by[61]["text"] == "" and by[61]["n_nodes"] == 0
    assert sum(by[i]["text"] == page(i)[1] for i in range(60)) >= 55
    model_less = extract_text(df.where("page_id >= 60")).collect()
    assert all(r["text"] is None for r in model_less) and len(model_less) == 3
    assert extract_text(df.limit(0)).count() == 0


def test_query_equals_pages_one_by_one(spark):
    from layerlode.llm.html import fit_extraction

    df = spark.createDataFrame([(i, "u", page(i)[0]) for i in range(80)], "page_id bigint, url string, html string")
    model = fit_extraction(df)
    got = {r["page_id"]: (r["text"], r["n_nodes"], r["n_content"]) for r in extract_text(df).collect()}
    assert got == {i: extract_batch(model, [page(i)[0]])[0] for i in range(80)}


def test_labels_come_from_tags_alone():
    assert weak_labels(parse("<div><p>x</p></div>")) is None
    y = weak_labels(parse("<div><article><p>x</p><nav>y</nav></article><p>z</p></div>"))
    assert y.tolist() == [-1, -1, 1, 1, 0, 0]


def test_repeated_pages_do_not_thin_the_sample(spark, monkeypatch):
    from layerlode.llm import html

    monkeypatch.setattr(html, "fit_pages", len)
    pages = spark.createDataFrame([(i, f"u{i}", page(i)) for i in range(6)], "page_id bigint, url string, html string")
    repeated = pages.crossJoin(spark.range(300)).drop("id")
    assert html.fit_extraction(repeated, train_pages=2) == 2
