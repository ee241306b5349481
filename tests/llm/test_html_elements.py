"""Style-tree importance inside and outside article elements, its formula, and the priors of names."""

import math
import random
import time
from collections import Counter

import pytest

from pagewright.llm import htmlmain


def plain_importance(pages):
    """The formula over one host's pages, each a tree of (step, children or text)."""
    seen: dict[tuple, list] = {}

    def walk(path, node):
        step, inner = node
        path = (*path, step)
        if isinstance(inner, str):
            seen.setdefault(path, []).append((page, (), [inner]))
        else:
            seen.setdefault(path, []).append((page, tuple(c[0] for i, c in enumerate(inner) if not i or c[0] != inner[i - 1][0]), []))
            for c in inner:
                walk(path, c)

    for page, tree in enumerate(pages):
        walk((), tree)
    out = {}
    for path, uses in seen.items():
        m = len({p for p, _, _ in uses})
        shapes = Counter(s for p in sorted({p for p, _, _ in uses}) for s in {s for q, s, _ in uses if q == p})
        texts = Counter(t for p in sorted({p for p, _, _ in uses}) for t in {t for q, _, ts in uses if q == p for t in ts})
        log = lambda x: math.log(x) / math.log(m)
        shape = 1.0 if m == 1 else -sum(c / m * log(c / m) for c in shapes.values())
        text = 1.0 if m == 1 or not texts else 1 - sum(log(c) for c in texts.values()) / len(texts)
        out[path] = (1 - htmlmain.GAMMA) * shape + htmlmain.GAMMA * text
    return out


def test_importance_is_that_of_the_formula(spark):
    rng = random.Random(2)
    trees, rows = [], []
    for i in range(9):
        # children of one kind stand together, so that each node is met once a page
        items = [("li", rng.choice(["a", "b", f"c{i}"]))]
        body = ("body", [("section", rng.choice([[("h1", f"t{i}"), ("p", "x")], [("p", f"y{i % 3}")]])), ("ul", items), *([("table", "same")] if i % 2 else [])])
        trees.append(body)
        html = lambda n: f"<{n[0]}>{n[1] if isinstance(n[1], str) else ''.join(map(html, n[1]))}</{n[0]}>"
        rows.append((i, "http://h/x", html(body)))
    want, node_of = plain_importance(trees), {}
    for path in want:
        node = 0
        for step in path:
            node = htmlmain._hash(step, node)
        node_of[node] = path
    got = {node_of[r.node]: r.importance for r in htmlmain.style_tree(spark.createDataFrame(rows, "page_id int, url string, html string")).collect() if r.node}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="wrap right-sidebar"><p>Real text</p></div>', "Real text"),
        ('<article class="post has-sidebar"><p>Body</p></article><p>x</p>', "Body\nx"),
        ('<div class="search-results">r</div><div class="related-work">w</div>', "r\nw"),
        ('<div class="widget"><article><p>in</p><div id="comments"><article class="comment">c</article></div></article></div><div class=ad>ad</div>', "in"),
        ('<div class="page search"><p>all</p><div class=ad>no</div></div>', "all"),
        ("<article></article><div class=ad>ad</div><nav>n</nav>", ""),
        ("<nav>n</nav><footer>f</footer>", ""),
        ('<div class="cookie-notice">n</div><p>t</p><div class="a b c d comments">c</div>', "t"),
    ],
)
def test_names_are_priors(html, text):
    assert "\n".join(htmlmain.Page(html).main_text({})) == text


def test_deep_pages_take_linear_time():
    began = time.time()
    assert htmlmain.Page("<div>" * 50_000 + "deep").main_text({}) == ["deep"]
    assert len(htmlmain.Page("<table><td><p>" + "<div>" * 20_000 + "<p>x</p></i>" * 20_000).blocks) == 20_000
    assert time.time() - began < 20


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (None, None, "<p>y"), (None, "http://a/", None)]
    for bound in (1000, 0):
        got = htmlmain.main_text(spark.createDataFrame(rows, "page_id int, url string, html string"), broadcast_nodes=bound).collect()
        assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (0, "y"), (1, "x"), (1, "x")]


def test_tree_decides_inside_and_outside_of_articles(spark):
    rows = []
    for i in range(12):
        own = " ".join(f"w{i}x{k}" for k in range(20))
        rows.append((i, f"http://a.com/{i}", f"<body><div class=x>Welcome</div><article><p>{own}</p><div class=y><p>Send this to a friend</p></div></article></body>", own))
        rows.append((100 + i, f"http://b.com/{i}", f"<body><div class=x>Welcome</div><article><h2>teaser {i}</h2></article><section><p>{own}</p></section></body>", f"teaser {i}\n{own}"))
        rows.append((200 + i, f"http://c.com/{i}", "<body><article><p>the same</p></article></body>", "the same"))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    for bound in (1000, 0):
        got = {r.page_id: r.text for r in htmlmain.main_text(pages, broadcast_nodes=bound).collect()}
        assert got == {r[0]: r[3] for r in rows}
