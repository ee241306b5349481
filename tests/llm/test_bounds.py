"""What was bounded once: many languages, many automata, long URLs, null and repeated ids; and plain versions of what the operators learn."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import decontam, langid, packing, pii, toxicity, urlfilter
from pagewright.llm.common import alnum_words


def word(rng, letters, n=6):
    return "".join(rng.choice(letters) for _ in range(n))


def test_every_language_is_learned(spark):
    """1,100 languages, each with words of its own: the rarest is predicted like any other."""
    rng, rows = random.Random(1), []
    vocab = [[word(rng, "abcdefghijklmnopqrstuvwxyz") for _ in range(12)] for _ in range(1100)]
    for k, words in enumerate(vocab):
        rows += [(len(rows) + i, f"l{k}", " ".join(words)) for i in range(2 if k else 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").selectExpr("doc_id", "lang", "text")
    model = langid.fit(docs)
    learned = {r[0] for r in docs.filter(~langid.held_out()).select("lang").distinct().collect()}
    assert set(model.languages) == learned and len(learned) > 1024
    own = [" ".join(vocab[int(name[1:])]).encode() for name in model.languages]
    assert model.predict(own)[0] == model.languages


def test_shares_are_those_of_plain_sets(spark):
    """Corrected shares against sets of n-grams without Bloom filters."""
    rng, rows = random.Random(2), []
    vocab = {"a": [word(rng, "abcde") for _ in range(60)], "b": [word(rng, "efghi") for _ in range(60)], "c": [word(rng, "cdefg") for _ in range(60)]}
    for k in range(240):
        lang = "abc"[k % 3]
        rows.append((k, lang, " ".join(rng.choice(vocab[lang]) for _ in range(30))))
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    train = [r for r in rows if langid_remainder(r[0]) != 2]
    grams = lambda t, s: [g for i in range(len(t) + 2 - s + 1) if "  " not in (g := f" {t} "[i : i + s])]
    sets, cover = {}, {}
    for lang in "abc":
        kept, all_n, kept_n = set(), 0, 0
        for s in langid.SIZES:
            n = Counter(g for _, own, t in train if own == lang for g in grams(t, s))
            total, have = sum(n.values()), 0
            for g, c in sorted(n.items(), key=lambda x: (-x[1], x[0].encode())):
                kept.add(g)
                have += c
                if have > langid.COVER * total:
                    break
            all_n, kept_n = all_n + total, kept_n + have
        sets[lang], cover[lang] = kept, kept_n / all_n
    texts = [" ".join(rng.choice(vocab[rng.choice("abc")]) for _ in range(25)) for _ in range(40)]
    got = model.shares([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        all_grams = [g for s in langid.SIZES for g in grams(t, s)]
        for lang, share in zip("abc", row, strict=True):
            assert abs(share - sum(g in sets[lang] for g in all_grams) / len(all_grams) / cover[lang]) < 0.03


def langid_remainder(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(1, "some words", None), (2, "123", None), (3, None, None), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in langid.keep_identified(docs).collect()] == [1]


def test_repeated_rows_and_null_ids_of_language(spark):
    rows = [(i % 5, "abc abd abe", "x") for i in range(20)] + [(None, "abc", None), (None, None, "x")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as score", "2 as share")).collect()
    assert len(got) == 22 and {(r.lang_pred, r.held_out) for r in got if r.doc_id is None} == {("x", False), ("und", False)}


@pytest.mark.parametrize("max_words", [100_000, 20])
def test_items_without_id_and_repeated_rows(spark, max_words):
    items = [(None, " ".join(f"a{i}" for i in range(12))), (None, "short one"), (7, " ".join(f"b{i}" for i in range(11))), (7, "other item"), (8, None), (9, "...")]
    docs = [(1, "x " + items[0][1] + " y short one"), (1, "x " + items[0][1] + " y short one"), (2, items[2][1] + " other item"), (None, "short one"), (None, "short one"), (3, "clean")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as __row2", "2 as hits")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.report(frame, bench, max_words=max_words).collect()))
    none, seven = (hashlib.sha256(x).hexdigest() for x in (b"", b"7"))
    assert got == [(0, 2, 2, 1, none), (0, 2, 2, 1, none), (1, 16, 14, 2, none), (1, 16, 14, 2, none), (2, 13, 13, 1, seven), (3, 1, 0, 0, none)]
    clean = decontam.decontaminate(frame, bench, max_words=max_words)
    assert clean.columns == frame.columns and sorted((r.doc_id, r.text) for r in clean.collect()) == [(3, "clean")]


def test_long_urls_are_walked_in_linear_time(spark):
    rng = random.Random(3)
    rules = (*urlfilter.BASE, *urlfilter.PATTERNS, urlfilter.Rule("tail", b"**.net/*zz*end", "block", False))
    urls = [b".a.net/" + bytes(rng.choice(b"abz/") for _ in range(n)) + rng.choice([b"zz-end", b"end", b""]) for n in (3, 40, 300_000, 500_000, 700)]
    urls += [b".example.com/en/7" + b"x" * 200_000]
    began = time.time()
    got = urlfilter.Automaton(rules).accepts(urls)
    assert time.time() - began < 20
    for u, row in zip(urls, got, strict=True):
        assert row[-1] == (u.startswith(b".a.net/") and u.endswith(b"end") and b"zz" in u[7:-3])
    assert got[-1][:2].all() and not got[-1][2:].any()
    table = spark.createDataFrame([("org/es/", None, "block", True), ("w", "**word**/*", "allow", False)], "name string, glob string, verdict string, base boolean")
    assert urlfilter.rules_of(table) == (urlfilter.host_rule("org/es/", "block"), urlfilter.Rule("w", b"**word**/*", "allow", False))


def test_account_numbers_after_their_cue():
    automaton = pii.anchors()
    found = lambda t: [t[s:e] for s, e in pii.find(t, automaton).get("account", ())]
    assert found("Account number: 12345678, thanks") == ["12345678"]
    assert found("account no. 12-34-56-78") == ["12-34-56-78"] and found("ACCOUNT NUMBER is 123 456 789.") == ["123 456 789"]
    assert found("account number 12345") == [] and found("account number A1234567") == [] and found("my number 12345678") == []
    assert found("account number: GB82 WEST 1234 5698 7654 32") == ["GB82 WEST 1234 5698 7654 32"]


def test_null_and_repeated_ids_spread_over_shards(spark):
    rows = [(None, "a b c")] * 300 + [(5, "a b c")] * 300
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), shard=50, tokens=30).collect()
    assert len(got) == 600 and len({r.batch_id.split("-")[1] for r in got if r.doc_id is None}) > 6
    sizes = Counter(r.batch_id for r in got)
    assert all(sizes[r.batch_id] == r.batch_docs <= 10 for r in got)


def test_ordinal_fit_is_a_maximum_of_the_plain_likelihood():
    rng = np.random.default_rng(4)
    x = (rng.random((300, 4)) < 0.4).astype(float)
    grades = np.clip(np.round(x @ [2.0, -1.0, 0.5, 0.0] + rng.logistic(size=300)), 0, 2).astype(int)
    rows, cols = np.nonzero(x)
    model = toxicity.fit_ordinal(rows, cols, np.ones(len(rows)), grades, 4, l2=1.0)

    def value(w, t):
        total = -0.5 * float(np.dot(w, w))
        for a, g in zip(x, grades, strict=True):
            above = [1.0, *(1 / (1 + np.exp(c - a @ w)) for c in t), 0.0]
            total += np.log(above[g] - above[g + 1])
        return total

    best = value(model.weights, model.thresholds)
    for k in range(6):
        for move in (-0.05, 0.05):
            w, t = model.weights.copy(), model.thresholds.copy()
            (w if k < 4 else t)[k if k < 4 else k - 4] += move
            assert value(w, t) < best


def test_features_and_repeated_rows_of_toxicity(spark):
    text = b"Grobheit grob grobe x"
    want = Counter({w: text.lower().split().count(w) for w in alnum_words(text)})
    for n in toxicity.STEMS:
        for w in alnum_words(text):
            if len(w) > n:
                want[w[:n] + b"*"] += 1
    assert toxicity.features(text) == want
    rng = random.Random(6)
    rows = [(i % 100, ("fies mies " if i % 100 < 30 else "") + " ".join(rng.choice("abcdefgh") * 3 for _ in range(20))) for i in range(200)] + [(None, "fies"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "3 as p_toxic")
    labels = spark.createDataFrame([(i, 1, int(i < 30)) for i in range(100)] * 2 + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.severity(docs, labels).collect()
    assert len(got) == 202 and all(r.toxic == (r.doc_id < 30) for r in got if r.doc_id is not None)
