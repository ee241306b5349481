"""The corpus operators against brute force, and on nulls, empties, repeats, ties and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from pagewright.llm import components, decontam, htmlmain, langid, licenses, packing, pii, simhash, topk, toxicity, urlfilter
from pagewright.llm.common import alnum_words
from pagewright.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, langs=None, ids=None, extra=""):
    ids = ids or list(range(len(texts)))
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs, strict=True)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *extra) if extra else df


def sentence(rng, n, voc=400):
    return " ".join(f"w{rng.randrange(voc)}" for _ in range(n))


# --- components -------------------------------------------------------------


def roots(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 3), (3, 5), (9, 8), (8, 3), (20, 21)], [(-(2**63), 2**63 - 1), (4, -7)]])
@pytest.mark.parametrize("hub", [100, 2])
def test_components(spark, pairs, hub, monkeypatch):
    monkeypatch.setattr(components, "HUB", hub)
    edges = spark.createDataFrame([*pairs, (None, 2), (2, None)], "a bigint, b bigint")
    want = roots([p for p in pairs if p[0] != p[1]])
    assert {r.node: r.root for r in connected_components(edges).collect()} == want


# --- 1: SimHash -------------------------------------------------------------


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n\x0b", "one", "One TWO", "é É x y z a", "a b c d e a b c d e", "x " * 70000])
@pytest.mark.parametrize("k", [3, 5])
def test_fingerprint(text, k):
    assert simhash.fingerprint(text.encode() if text is not None else None, k) % (1 << 64) == plain_fingerprint(text, k)


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 7])
def test_links_in_groups(radius):
    rng = np.random.default_rng(radius)
    made = []
    for c in rng.integers(0, 2**63, 12).astype(np.uint64):
        for _ in range(rng.integers(1, 150)):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, radius + 3)):
                x ^= 1 << int(b)
            made.append(x)
    fps = np.unique(np.array(made, dtype=np.uint64))
    rng.shuffle(fps)
    keys = np.sort(rng.integers(0, 4, len(fps)))
    label = simhash.link_groups(keys, fps, radius)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if keys[i] == keys[j] and bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius]
    want = roots(pairs)
    assert [want.get(i, i) for i in range(len(fps))] == list(label)


@pytest.mark.parametrize(("radius", "bucket", "slices", "keys"), [(3, 4096, 4, 50_000), (3, 16, 4, 50_000), (3, 7, 6, 50_000), (5, 32, 7, 50_000), (3, 7, 5, 0)])
def test_near_duplicates(spark, radius, bucket, slices, keys, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", keys)
    rng = random.Random(radius + bucket)
    texts = [None, "", " ", "only"]
    for _ in range(25):
        words = sentence(rng, rng.randrange(1, 120)).split()
        for _ in range(rng.randrange(1, 12)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += texts[3:9]
    docs = docs_of(spark, texts, extra=["'x' as fp", "1 as component_id", "2 as key"])
    old = simhash.slices_for
    simhash.slices_for = lambda n, r: slices
    try:
        got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, words=3, radius=radius, bucket_rows=bucket).collect()}
    finally:
        simhash.slices_for = old
    fp = [plain_fingerprint(t, 3) for t in texts]
    want = roots([(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if bin(fp[i] ^ fp[j]).count("1") <= radius])
    assert got == {i: (f, want.get(i, i)) for i, f in enumerate(fp)}


def test_near_duplicates_keeps_repeated_rows_and_empty_tables(spark):
    docs = docs_of(spark, ["a b c", "a b c", "x y z q"], ids=[7, 7, None])
    rows = simhash.near_duplicates(docs)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows.collect()) == [(-1, -1), (7, 7), (7, 7)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


# --- 2: toxicity ------------------------------------------------------------


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(1)
    n, d = 4000, 6
    x = (rng.random((n, d)) < 0.4).astype(float)
    w = np.array([2.0, -1.5, 1.0, 0.0, 0.5, -0.5])
    z = x @ w + rng.logistic(size=n)
    grades = (z[:, None] > np.array([-0.5, 1.0, 2.0])).sum(1)
    rows, cols = np.nonzero(x)
    m = toxicity.fit_ordinal(rows, cols, np.ones(len(rows)), grades, d, l2=0.1)
    assert np.abs(m.weights - w).max() < 0.35
    assert np.all(np.diff(m.thresholds) > 0) and np.abs(m.thresholds - [-0.5, 1.0, 2.0]).max() < 0.35
    assert np.abs(m.expected(x @ m.weights).mean() - grades.mean()) < 0.05


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    bad = ["grob", "mies", "fies", "übel"]
    texts, truth = [], []
    for i in range(1200):
        words = sentence(rng, rng.randrange(5, 80)).split()
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 8) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + "!")
        texts.append(" ".join(words))
        truth.append(toxic)
    docs = docs_of(spark, [*texts, None, ""], extra=["0 as toxic", "0 as severity"])
    labels = spark.createDataFrame([(i, 1, int(truth[i])) for i in range(600)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.severity(docs, labels).collect()}
    assert len(got) == 1202
    right = sum(got[i].toxic == truth[i] for i in range(600, 1200))
    assert right >= 0.97 * 600
    assert not got[1200].toxic and not got[1201].toxic and 0 <= got[1200].severity <= 3


def test_toxicity_without_both_classes(spark):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert [(r.severity, r.toxic) for r in toxicity.severity(docs_of(spark, ["a", None]), labels).collect()] == [(0.0, False)] * 2
    assert toxicity.severity(docs_of(spark, ["a"]).limit(0), labels.limit(0)).collect() == []


# --- 3: language ------------------------------------------------------------


def test_language_held_out(spark):
    rng = random.Random(2)
    parts = {"aa": ["the", "ing", "and", "tion", "er"], "bb": ["sch", "ung", "ß", "ein", "ü"], "cc": ["é", "eau", "ou", "ê", "ment"]}
    texts, langs = [], []
    for _ in range(600):
        lang = rng.choice(list(parts))
        texts.append(" ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))))
        langs.append(lang)
    docs = docs_of(spark, [*texts, None, "", "12 + 3", "漢字漢字", "ÉÊ MENT"], langs=[*langs, "aa", None, None, None, None], extra=["'zz' as lang_pred", "1 as score", "1 as share"])
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert 100 < len(held) < 200
    assert sum(got[i].lang_pred == langs[i] for i in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3
    assert got[603].lang_pred in parts and got[603].score == 0 and got[604].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id: r.lang for r in langid.keep_identified(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()}
    assert set(kept) == {*range(600), 604} and kept[604] == "cc"


def test_language_without_training_rows(spark):
    docs = docs_of(spark, ["abc", None], langs=[None, None])
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und", "und"]
    assert langid.identify(docs.limit(0)).collect() == [] and [r.text for r in langid.keep_identified(docs).collect()] == ["abc"]


def test_long_texts_are_cut_into_pieces_without_loss():
    model = langid.Model(["a"], np.full((1, 1 << langid.ROWS_LOG2), 1, dtype=np.uint8), np.zeros(1), np.ones(1), 0)
    old = langid.CHUNK
    texts = [b"abc def " * 500, b"", b"x", b"hello world again"]
    whole = model.shares(texts)
    langid.CHUNK = 7
    try:
        assert np.array_equal(model.shares(texts), whole)
    finally:
        langid.CHUNK = old


# --- 4: top-k ---------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_top_k(spark, spread, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(topk, "BROADCAST_DIMS", 0)
        monkeypatch.setattr(topk, "BROADCAST_HEADS", 0)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        v = rng.normal(size=6) * np.exp(spread * rng.normal())
        if i % 7 == 0:
            v = np.ones(6) * 0.5
        rows.append((i, [float(x) for x in v], 0))
    rows += [(1000, None, 0), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1200, [float("nan")] * 6, 0), (1300, [float("inf")] * 6, 0), (1400, [0.0] * 6, 0), (1500, [1.0, 2.0], 0), (1600, [3.0, -2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = [tuple(r) for r in topk.top_k(df, "vec_id % 100 = 0", k=10, bucket=64, queries=4).orderBy("query_id", "rank").collect()]
    v = {i: [int(np.floor(1024 * x)) for x in e] for i, e, _ in rows if e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in sorted(i for i in v if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:10]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), "vec_id % 100 = 0").collect() == []


def test_blocks_are_kept_in_few_bytes():
    for top, width in ((2**15 - 1, 2), (2**15, 4), (2**31 - 1, 4), (2**31, 8), (-(2**15), 2)):
        data = topk._narrow(np.array([top, -3, 0, 7], dtype=np.int64))
        assert len(data) == 4 * width
        ids = np.arange(2, dtype=np.int64).tobytes()
        assert topk._open(2, 2, ids, np.ones(2).tobytes(), data)[2].tolist() == [[top, -3], [0, 7]]


def test_products_stay_exact():
    rng = np.random.default_rng(1)
    for size in (2**10, 2**27, 2**34):
        q, p = rng.integers(-size, size, (3, 5)), rng.integers(-size, size, (4, 5))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in p] for x in q]
        assert topk.products(q, p).tolist() == want


# --- 5: packing -------------------------------------------------------------


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        buckets = rng.randint(1, 4)
        bounds = packing.optimal_bounds(lengths, counts, buckets)
        best = min(packing.padding(lengths, counts, sorted(c) + [int(lengths[-1])]) for k in range(buckets) for c in itertools.combinations([int(x) for x in lengths[:-1]], min(k, len(lengths) - 1)))
        assert len(bounds) <= buckets and packing.padding(lengths, counts, bounds) == best


def test_packing(spark):
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(0, 50)) for _ in range(500)] + [None, "", sentence(rng, 300)]
    docs = docs_of(spark, texts, extra=["1 as bucket", "2 as n_tokens", "3 as __p"])
    rows = packing.pack(docs, buckets=4, tokens=100, shard=60).collect()
    assert sorted(r.doc_id for r in rows) == list(range(503))
    assert all(r.n_tokens == len((texts[r.doc_id] or "").split()) <= r.bucket_tokens for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    for b in batches.values():
        assert {r.batch_docs for r in b} == {len(b)} and len({r.bucket for r in b}) == 1
        assert len(b) == 1 or len(b) * b[0].bucket_tokens <= 100 or b[0].bucket_tokens == 0
    assert packing.pack(docs.limit(0)).collect() == []
    coarse = packing.pack(docs, buckets=4, tokens=100, grid=5).collect()
    assert all(r.n_tokens <= r.bucket_tokens for r in coarse) and len(coarse) == 503


# --- 6: HTML ----------------------------------------------------------------

PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Buy</div>%s<footer>&copy; f</footer>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (PAGE % "<article><h1>H&amp;1</h1><p><b>one  two<br><p>th\tree</p><div class='comments'><p>first!</p></div></article>", "H&1\none two\nth ree"),
        (PAGE % "<div id=content><p>a<p>b <i>c</i>d</div>", "a\nb cd"),
        ("<header>site</header><main><header><h1>T</h1></header><p>b<form>f</form></main>", "T\nb"),
        ('<a title="x>y">t</a> &amp;amp; &#233;&nbsp;z<!-- no > no -->!', "t & é z!".replace("& ", "&amp; ")),
        ("<table><tr><td>1<td>2<tr><th>3</table>", "1\n2\n3"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>d", "a\nb\nc\nd"),
        ("plain < text <p", "plain < text"),
        ("<p>unclosed <b>bold<p>next</b>", "unclosed bold\nnext"),
        ("<div>a</div></div></p>b", "a\nb"),
        ("", ""),
    ],
)
def test_main_text_of_a_page(html, text):
    assert "\n".join(htmlmain.Page(html).main_text({})) == text


def test_style_tree_removes_what_a_host_repeats(spark):
    rng = random.Random(3)
    rows = []
    for i in range(12):
        own = sentence(rng, 20)
        rows.append((i, f"http://A.com/{i}", f"<body><div class=x><p>Welcome to our site</p></div><section><p>{own}</p></section></body>", own))
    rows += [(50, "http://b.com/", "<body><div class=x><p>Welcome to our site</p></div></body>", "Welcome to our site"), (51, None, None, ""), (52, "u", "", ""), (53, None, "<p>x", "x")]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as low")
    for bound in (1000, 0):  # broadcast and joined
        got = {r.page_id: (r.url, r.text, r.n_chars) for r in htmlmain.main_text(pages, broadcast_nodes=bound).collect()}
        assert got == {i: (u, t, len(t)) for i, u, _, t in rows}
    tree = {r.node: r.importance for r in htmlmain.style_tree(pages).filter("host = 'a.com'").collect()}
    assert min(tree.values()) < 0.2 and max(tree.values()) > 0.8
    assert htmlmain.main_text(pages.limit(0)).collect() == []


# --- 7: personal data -------------------------------------------------------


def base_spans(text):
    out = {}
    for kind, pattern in pii.BASE.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                spans.append(m.span())
        if spans:
            out[kind] = spans
    return out


def test_base_spans_agree_with_the_patterns():
    rng, automaton = random.Random(5), pii.anchors()
    for i in range(20000):
        text = "".join(rng.choice("ab1234567890.@+-() %_é4" if i % 3 else "0123456789 -") for _ in range(rng.randrange(60)))
        if i % 5 == 0:
            text = text.replace("a", "1.2")
        found = pii.find(text, automaton)
        assert {k: v for k, v in found.items() if k in pii.BASE} == base_spans(text), text


def test_pii_report_and_redaction(spark):
    card = "4111 1111 1111 1111"
    texts = [None, "", "clean text", f"é a.b@c.de and 10.0.0.1, {card}; +1 (663) 555-6869.", 'token = "11acdfb36bb72224" iban: DE89 3704 0044 0532 0130 00 http://u:p4ss@h.org/', "9" * 6000 + ".1.1.1"]
    docs = docs_of(spark, texts, extra=["'x' as spans", "0 as n_email"])
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert (got[3].n_email, got[3].n_ip, got[3].n_card, got[3].n_phone) == (1, 1, 1, 1)
    assert got[3].base_sha256 == hashlib.sha256(got[3].spans.encode()).hexdigest()
    assert got[3].spans.startswith("email:2:10,ip:15:23,card:25:44") and got[3].n_spans == 4
    assert got[0].spans == got[1].spans == got[2].spans == got[5].spans == ""
    assert [s.split(":")[0] for s in got[4].spans.split(",")] == ["email", "url", "secret", "account"]
    red = {r.doc_id: r for r in pii.redact(docs.select("doc_id", "text", "n_chars")).collect()}
    assert red[3].text == "é <EMAIL> and <IP>, <CARD>; <PHONE>." and red[3].n_chars == len(red[3].text)
    assert red[4].text == 'token = "<SECRET>" iban: <ACCOUNT> http://<EMAIL>/' and red[0].text is None and red[2].text == "clean text"
    assert pii.report(docs.limit(0)).collect() == []


# --- 8: URLs ----------------------------------------------------------------


def test_automaton_agrees_with_the_rules():
    rng = random.Random(2)
    rules = (*urlfilter.BASE, *urlfilter.PATTERNS)
    hosts = ["example.com", "a.example.com", "xexample.com", "com", "net", "example.net", "o.example.net", "casino-x.org", "com:80", "free-bets.COM", "", "y.com.net"]
    paths = ["", "/", "/en/", "/en/7", "/en/77", "/de/8", "/es/", "/x.com/en/", "/casino/", "//en/", "/é.net/de/"]
    urls = [rng.choice(["http://", "://", "", "ftp:"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=1", "#a/b", "?x=com/en/"]) for _ in range(2000)]
    parts = [urlfilter.split_url(u.encode()) for u in urls]
    got = urlfilter.Automaton(rules).accepts([b"." + h + p if h or p else b"" for h, p in parts])
    for (h, p), row in zip(parts, got, strict=True):
        h, p = h.decode(), p.decode()
        for r, ok in zip(rules, row, strict=True):
            if r.base:
                rh, rp = r.name.split("/", 1)
                assert ok == ((h == rh or h.endswith("." + rh)) and p.startswith("/" + rp))
            else:
                assert ok == (r.name in h and p.startswith("/"))


def test_judge(spark):
    rows = [(1, "http://a.Example.com/en/7?x"), (2, "http://example.com/en/8"), (3, None), (4, "no scheme"), (5, "https://x.casino.org/"), (6, "http://example.net/de/81#f"), (6, "http://example.net/de/81#f"), (7, "http://ok.org")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as host", "2 as rule")
    got = sorted(tuple(r) for r in urlfilter.judge(pages).collect())
    assert got[0] == (1, "a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == (2, "example.com", "/en/8", "com/en/", "block")
    assert got[2] == (3, "", "", None, "allow") and got[3] == (4, "", "", None, "allow")
    assert got[4] == (5, "x.casino.org", "/", None, "block")
    assert got[5] == got[6] == (6, "example.net", "/de/81", "example.net/de/8", "block")
    assert got[7] == (7, "ok.org", "", None, "allow")
    assert urlfilter.judge(pages.limit(0)).collect() == []


def test_base_rules_have_the_verdicts_of_the_contract(spark):
    assert [(r.name, r.verdict) for r in urlfilter.BASE] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    pages = spark.createDataFrame([(1, "http://casino.a.net/de/1"), (2, "http://example.net/de/7"), (3, "http://x.example.net/de/8")], "page_id bigint, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()) == [(1, "net/de/", "allow"), (2, "net/de/", "allow"), (3, "example.net/de/8", "block")]


# --- 9: licences ------------------------------------------------------------


def plain_finds(words, template, size, need):
    """Every window of ``size`` words, counted afresh; overlapping ones made one."""
    out = []
    for i in range(max(1, len(words) - size + 1)):
        at = [p for p in range(i, min(i + size, len(words))) if words[p] in template]
        shared = len({words[p] for p in at})
        if shared >= need:
            x = (at[0], at[-1] + 1, shared / len(template))
            if out and x[0] < out[-1][1]:
                x = (out[-1][0], max(x[1], out[-1][1]), max(x[2], out[-1][2]))
                out.pop()
            out.append(x)
    return out


def test_join_finds_exactly_the_blocks():
    rng = random.Random(7)
    templates = [("a", "one two three four five"), ("b", "two two six seven eight nine ten one"), ("c", "three"), ("d", "five six five six five")]
    vocab = sorted({w.encode() for _, t in templates for w in t.split()})
    join = licenses.Join({w: rng.randrange(50) for w in vocab}, templates)
    for k in range(1500):
        share = rng.choice([0.2, 0.6, 1.0])
        words = [rng.choice(vocab) if rng.random() < share else b"x" for _ in range(rng.randrange(40))]
        want = [(t, *f) for t, (_, ranked, need, size) in enumerate(join.templates) for f in plain_finds(words, set(ranked), size, need)]
        assert join.find(words) == want, k


def test_wrapped_notices_and_long_lines_are_found_and_scattered_words_not():
    join = licenses.Join(dict.fromkeys(frozenset().union(*(s for _, s in licenses.template_sets())), 0))
    labels = lambda text: {join.templates[f[0]][0] for f in join.find(licenses.alnum_words(text.encode()))}
    mit = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n */"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
    apache = "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://x"
    assert labels(mit) == {"mit"} and labels(bsd) == {"bsd"} and labels(apache) == {"apache-2.0"}
    assert labels("lead " * 5000 + mit.replace("\n", " ") + " tail" * 5000) == {"mit"}
    assert labels((" filler" * 30).join(bsd.split())) == set()
    assert labels("Released under\nthe MIT License") == {"mit"}


def test_places_take_linear_time():
    words = [b"cc", b"by"] * 100_000
    found = licenses.places(words, [(b" cc by ", "cc-by")])
    assert [s for s, _ in found] == list(range(0, 200_000, 2))


def test_license_report(spark):
    texts = [None, "", "x CC-BY cc by y. All rights\nreserved", "Licensed under the Apache License, Version 2.0.", "general public", "a GENERAL public License"]
    docs = docs_of(spark, texts, extra=["1 as labels", "2 as score"])
    got = {r.doc_id: r for r in licenses.report(docs).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (0, 0, None, "", 0.0)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (9, 3, 1, 6, "cc-by,reserved")
    assert (got[3].labels, got[3].base_labels, got[3].score) == ("apache-2.0", "", 1.0)
    assert got[4].labels == "" and got[5].base_labels == "gpl"
    assert {(r.doc_id, r.label) for r in licenses.matches(docs).collect()} == {(3, "apache-2.0")}
    assert licenses.report(docs.limit(0)).collect() == []


# --- 10: decontamination ----------------------------------------------------


def brute_hits(items, doc, window):
    hit, found = [False] * len(doc), set()
    for name, words in items:
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == words[i : i + n]:
                    found.add(name)
                    hit[j : j + n] = [True] * n
    return hit, found


def test_automaton_agrees_with_brute_force():
    rng = random.Random(3)
    voc = [b"%d" % i for i in range(4)]
    for trial in range(1500):
        window = rng.choice([3, 4, 10])
        items = [(str(k), [rng.choice(voc) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12]))]) for k in range(rng.randint(0, 5))]
        doc = [rng.choice(voc + [b"z"] * (trial % 2)) for _ in range(rng.randint(0, 40))]
        runs, found = decontam.Automaton(items, window).hits(doc)
        hit = [False] * len(doc)
        for s, e in runs:
            hit[s:e] = [True] * (e - s)
        assert (hit, found) == brute_hits(items, doc, window)


@pytest.mark.parametrize("max_words", [100_000, 30])
def test_decontamination(spark, max_words):
    rng = random.Random(9)
    items = [sentence(rng, n, 60) for n in (12, 25, 4, 0, 11)] + [None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    texts = [None, "", sentence(rng, 30)]
    for t in items[:5]:
        texts += [f"{sentence(rng, 5)}. {t.upper()}! {sentence(rng, 30)}", t]
    docs = docs_of(spark, texts, extra=["1 as item_id", "2 as n_hit"])
    got = {r.doc_id: r for r in decontam.report(docs, bench, max_words=max_words).collect()}
    named = [(str(i), alnum_words(t.encode())) for i, t in enumerate(items) if t]
    for i, t in enumerate(texts):
        words = alnum_words((t or "").encode())
        hit, found = brute_hits(named, words, 10)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(words), sum(hit), len(found), any(hit))
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in decontam.decontaminate(docs.select("doc_id", "text", "n_chars"), bench, max_words=max_words).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == texts[2]
    assert 4 not in clean and items[0].upper() not in clean[3] and clean[3].split()[:4] == texts[3].split()[:4]
    assert decontam.report(docs.limit(0), bench).collect() == []
    assert {r.n_hit for r in decontam.report(docs, bench.limit(0)).collect()} == {0}
