"""Toxic spans, pseudonyms and web pages against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import html_extraction as W
from rankspark.llm import pii as P
from rankspark.llm import toxicity as T

SCHEMA = "doc_id long, text string"


# ---- toxicity ------------------------------------------------------------------


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 6, 2])
    emission, start, move = rng.normal(size=12), 0.7, rng.normal(size=(2, 2))
    p, moves, _ = T.Chains(lengths).marginals(emission, start, move, pairs=True)
    want, want_moves, low = [], np.zeros((2, 2)), 0
    for n in lengths:
        own = emission[low : low + n]
        low += n
        total, single, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(start * tags[0] + sum(e * t for e, t in zip(own, tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            single += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                pairs[a, b] += w
        want += list(single / total)
        want_moves += pairs / total
    assert p == pytest.approx(np.array(want))
    assert moves == pytest.approx(want_moves)


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (0, "", "xx", "", 0), (1, "you idiot clown,\nidiot scum trash", None, None, None)], docs.schema)
    got = T.toxicity(docs.union(odd).withColumn("score", F.lit("mine")), labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hits = sum(r.predicted for r, y in held if y)
    assert hits / sum(y for _, y in held) > 0.85
    assert sum(r.predicted for r, y in held if not y) / sum(not y for _, y in held) < 0.02
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    planted = [r for r in got if r.doc_id == 1 and len(r.spans) == 2]
    assert [(s.start, s.end) for s in planted[0].spans] == [(4, 16), (17, 33)] and planted[0].predicted == 1
    assert {r.score for r in T.toxicity(docs.limit(20), labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in T.toxicity(docs.limit(20), labels.where("toxic = 0")).collect()} == {0.0}
    assert T.toxicity(docs.limit(0), labels).collect() == []


def test_long_labelled_texts_teach(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "river bridge night winter train road".split() for b in "abcdefghij"]

    def text(toxic):
        lines = [" ".join(rng.choices(words, k=12)) for _ in range(400)]
        if toxic:
            for at in rng.sample(range(400), 40):
                lines[at] += " gnarfing idiot"
        return "\n".join(lines)

    rows = [(k, text(k % 2), k % 2) for k in range(120)]
    assert min(len(t) for _, t, _ in rows) > 20_000
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = T.toxicity(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got) and any(r.spans for r in got)
    assert len(T.excerpt(rows[1][1].encode())) <= T.EXCERPT_BYTES and T.excerpt(b"x" * 50_000) == b"x" * T.EXCERPT_BYTES
    assert (T.MAX_TOXIC, T.MAX_CLEAN) == (2_000, 3_000)


# ---- personal data ----------------------------------------------------------------


def brute_text(value, key, hexadecimal=False):
    half = len(value) // 2
    a, b = value[:half], value[half:]
    for r in range(P.ROUNDS):
        digest = hashlib.sha512(f"{key}:{r}:{b}".encode()).hexdigest()
        out = []
        for i, c in enumerate(a):
            by = int(digest[i % 32 * 4 : i % 32 * 4 + 4], 16)
            if hexadecimal:
                out.append("0123456789abcdef"[(int(c, 16) + by) % 16])
            elif c.isascii() and c.isdigit():
                out.append(chr((ord(c) - 48 + by) % 10 + 48))
            elif c.isascii() and c.isalpha():
                first = 65 if c.isupper() else 97
                out.append(chr((ord(c) - first + by) % 26 + first))
            else:
                out.append(c)
        a, b = b, "".join(out)
    return a + b


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_networks_match_plain_python_and_are_bijections(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZ0189.@- ") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.feistel_text(F.col("t"), "k").alias("p"))
    assert [r.p for r in frame.collect()] == [brute_text(t, "k") for t in texts]
    codes = [f"{rng.getrandbits(160):040x}" for _ in range(20)]
    frame = spark.createDataFrame([(t,) for t in codes], "t string").select(P.feistel_text(F.col("t"), "k", True).alias("p"))
    assert [r.p for r in frame.collect()] == [brute_text(t, "k", True) for t in codes]
    threes = spark.range(1000).select(P.feistel_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k").alias("p"))
    assert len({r.p for r in threes.collect()}) == 1000
    pair = spark.range(7 * 11).select(P.feistel_pair(F.floor(F.col("id") / 11), F.col("id") % 11, 7, 11, "k").alias("s")).select("s.*")
    assert len({(r.a, r.b) for r in pair.collect()}) == 77
    days = spark.range(0, 73049, 13).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    made = days.select("d", P.pseudonym(F.col("d")).alias("p")).collect()
    assert len({r.p for r in made}) == len(made) and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", r.p) for r in made)
    digits = [f"4{rng.randrange(10**14):014d}" for _ in range(50)]
    got = spark.createDataFrame([(d,) for d in digits], "d string").select("d", P.check_digit(F.col("d")).alias("c")).collect()
    assert all(luhn(r.d + r.c) for r in got)


CASES = [
    ("mail the.99@mail9.example.com, x", 1), ("ip 233.233.171.252!! and 1.2.3.4.", 2), ("bad 999.1.1.1 and 01.2.3.4", 0),
    ("2024-02-29 and 31/12/1999 and 12/25/2020 and 5/6/2020 1.2.1999", 5), ("2024-02-30 1799-01-01 31/02/2000", 0),
    ("card 4785380592391139$$$ 4785 3805 9239 1139 4785-3805-9239-1139", 3), ("4785380592391138 12345678901234567890", 0),
    ("4465758382889437 4465758382889437", 2), ("+1 (743) 555-3824 éeux (743) 555-3824 743-555-3824", 3), ("123-45-6789", 1),
    ('token = "7c72db563d7f6e50cec00950f7bab1f2223b6afd" 7C72DB563D7F6E50CEC00950F7BAB1F2223B6AFD', 2), ("nothing here, 12 and 3.5%", 0),
    ("x" * 500_000 + " 1.2.3.4 " + "y " * 200_000, 1),
]


def test_values_are_replaced_within_their_format(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(97, None), (98, ""), (1, CASES[1][0]), (None, "9.8.7.6")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n_pii", F.lit("x")).withColumn("found", F.lit(1))
    got = {r.doc_id: r for r in P.pii(frame).collect()}
    assert P.pii(frame).count() == len(rows)
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    for i, (text, n) in enumerate(CASES):
        assert got[i].n_pii == n, text
        assert (got[i].text == text) == (n == 0)
        if i not in (1, 3, 10, 12):
            assert shape(got[i].text) == shape(text)
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}", got[5].text)
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and luhn(re.sub(r"\D", "", cards[0])) and cards[0][0] == "4"
    assert len(set(got[7].text.split())) == 1
    assert got[1].text.split()[3] == [x for x in got[12].text.split() if x.count(".") == 3][0] + "."
    assert all(int(o) < 256 for o in re.findall(r"\d+", got[1].text))
    assert got[97].text is None and got[97].n_pii == 0 and got[98].text == ""
    other = {r.doc_id: r.text for r in P.pii(frame, key="another").collect()}
    assert other[1] != got[1].text and other[11] == got[11].text
    assert P.pii(frame.limit(0)).collect() == []
    plan = P.pii(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- web pages ------------------------------------------------------------------


def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style></head><body class="Home page">
    <!-- <p>no</p> --><nav><a href="a>b">Go</a></nav><p>One &amp;lt; <b>t<i>w</i>o</b>&nbsp;&#233;<br>three<p>Next < 5 & so <script>var t="</p>";</script>on
    <ul><li>a<li>b</ul><div id=x>tail"""
    got = [(path[-1], text, linked) for path, text, linked in W.blocks(page)]
    assert got == [("a", "Go", 2), ("p", "One &lt; two é three", 0), ("p", "Next < 5 & so on", 0), ("li", "a", 0), ("li", "b", 0), ("#x", "tail", 0)]
    assert W.blocks("") == [] and W.blocks("<p> </p><") == [((), "<", 0)] and W.blocks("<!-- open") == []


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    size = W.PATH_SLOTS + W.WORD_SLOTS + W.LENGTHS
    pages = [rng.normal(size=(n, size)).astype(np.float32) * 0.3 for n in (4, 2, 5)]
    labels = [np.array([1, 0, 1, 1.0]), np.array([0, 1.0]), np.array([1, 1, 0, 0, 1.0])]
    net = {k: v.astype(np.float64) for k, v in W.new_network().items()}
    x, mask = W._padded(pages)
    x, mask = x.astype(np.float64), mask.astype(np.float64)
    y = np.zeros_like(mask)
    for k, own in enumerate(labels):
        y[: len(own), k] = own

    def loss():
        states = np.concatenate([W._run(net, x, mask, way)[0].astype(np.float64) for way in "fb"], axis=2)
        p = W._sigmoid(states @ net["V"] + net["v"][0])
        return float(-((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())

    grads = {k: np.zeros_like(v) for k, v in net.items()}
    runs = {way: W._run(net, x, mask, way) for way in "fb"}
    states = np.concatenate([runs[way][0] for way in "fb"], axis=2)
    error = (W._sigmoid(states @ net["V"] + net["v"][0]) - y) * mask / mask.sum()
    d_states = error[:, :, None] * net["V"]
    for k, way in enumerate("fb"):
        W._run_back(net, x, runs[way][1], way, d_states[:, :, k * W.HIDDEN : (k + 1) * W.HIDDEN], grads)
    for name in ("Wf", "Uf", "bf", "Wb", "Ub", "bb"):
        flat, grad = net[name].reshape(-1), grads[name].reshape(-1)
        for at in np.argsort(-np.abs(grad))[:3]:
            old = flat[at]
            flat[at] = old + 1e-2
            high = loss()
            flat[at] = old - 1e-2
            low = loss()
            flat[at] = old
            assert grad[at] == pytest.approx((high - low) / 2e-2, rel=0.05, abs=1e-6)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    other = """<html><body><header class="site-header"><h1>Site</h1></header><div id="cookie-banner"><p>We use cookies here.</p></div><main><article><h1>A title &amp; more</h1>
    <p>First <b>part</b> of it.</p><aside class="related"><ul><li>Other</li></ul></aside><p>Second part.</p></article><section class="comments"><p>I liked this very much.</p></section>
    </main><form action="/s"><label>Mail</label><button>Go</button></form><footer>&copy; Us</footer></body></html>"""
    long = "<article>" + "<p>word after word.</p>" * 20_000 + "</article>"
    odd = spark.createDataFrame([(None, None, None), (-1, "u", ""), (-2, "u", other), (-2, "u", other), (-3, None, long)], pages.schema)
    rows = pages.union(odd).withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(None))
    got = W.extract(rows).collect()
    assert len(got) == pages.count() + 5
    texts = {r.page_id: r.text for r in got}
    assert all(r.n_chars == len(r.text) for r in got)
    wrong = 0
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        wrong += texts[r.page_id] != " ".join(t for _, t, _ in W.blocks(article))
    assert wrong <= 1
    assert texts[None] == texts[-1] == ""
    assert texts[-2] == "A title & more First part of it. Second part."
    assert texts[-3] == " ".join(["word after word."] * 20_000)
    assert W.extract(pages.limit(0)).collect() == []


def test_labeller_learns_from_long_pages(spark):
    rng = random.Random(5)
    words = "river bridge council night winter train library road wind measure".split()
    sentence = lambda: " ".join(rng.choices(words, k=12)).capitalize() + "."

    def page(n):
        main = [sentence() for _ in range(n)]
        body = "".join(f"<p>{m}</p>" for m in main)
        return f"<html><body><nav><a href='/'>Home</a></nav><article>{body}</article><footer><p>Imprint and terms</p></footer></body></html>", " ".join(main)

    made = [page(700) for _ in range(6)]
    assert all(len(html) > 30_000 for html, _ in made)
    rows = [(k, "u", html) for k, (html, _) in enumerate(made)] + [(None, "u", page(700)[0])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in W.extract(frame).collect()}
    assert [texts[k] for k in range(6)] == [main for _, main in made] and texts[None]
    found = W.blocks(made[0][0])
    parts = W.ranges(found, 6, 1)
    assert sorted(b for part in parts for b in part) == sorted(found)  # one page may fill the sample: nothing is left out
    ends = [any(b[1] == "Imprint and terms" for part in W.ranges(found, 1, seed) for b in part) for seed in range(60)]
    assert 8 < sum(ends) < 35 and W.ranges([], 3, 1) == [] and len(W.ranges(found[:240], 5, 1)) == 2


def test_labeller_without_sampled_texts():
    net = W.fit([])
    page = "<body><nav><a>Home</a></nav><article><p>The first walkers came early in the day.</p><p>Rain fell until noon.</p></article><footer><p>© Us</p></footer></body>"
    assert W.main_text(net, [page], {}) == ["The first walkers came early in the day. Rain fell until noon."]


def test_container_in_the_middle_of_a_deep_path(spark):
    def deep(inner, n):
        return "".join(f'<div id="l{k}" class="a b c d e f g{k}">' for k in range(n)) + inner + "</div>" * n

    def page(k):
        words = [f"Word {k} and {j} went by the river." for j in range(4)]
        article = "<article>" + deep("".join(f"<p>{w}</p>" for w in words), 8) + "</article>"
        aside = '<section class="sidebar">' + deep("".join(f"<p>See {w}</p>" for w in words), 8) + "</section>"
        order = (article, aside) if k % 2 else (aside, article)
        return "<html><body>" + deep("".join(order), 8) + "</body></html>", " ".join(words)

    made = [page(k) for k in range(60)]
    labels = [[W.own_label(path) for path, _, _ in W.blocks(html)] for html, _ in made]
    assert all(sorted(own) == [0] * 4 + [1] * 4 for own in labels)
    frame = spark.createDataFrame([(k, "u", html) for k, (html, _) in enumerate(made)], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in W.extract(frame).collect()}
    assert sum(texts[k] == want for k, (_, want) in enumerate(made)) >= 58
    slots = [W._path_names(("html", "body", *["div", ".w"] * 9, middle, *["div", ".w"] * 9)) for middle in (".sidebar", ".story")]
    assert slots[0] != slots[1]
    assert ".seventh" in W.blocks('<div class="a b c d e f seventh">x</div>')[0][0]
