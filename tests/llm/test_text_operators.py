"""Host rules, decontamination, language-model scores and quality against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import decontamination as D
from rankspark.llm import host_rules as H
from rankspark.llm import lm_scoring as L
from rankspark.llm import quality as Q

SCHEMA = "doc_id long, text string, source string"


def words_of(text):
    return (text or "").encode().split()


# ---- host rules ---------------------------------------------------------------


@pytest.mark.parametrize(
    "text", ["", "a", "a b c", "a b c a b c", "x x x x x", "one\ntwo\none\n\n \none", "é ñ# é ñ# | é ñ#", "a b c d a b c e b c d", " \t\x0b\n"]
)
def test_measures(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    lines = [line for line in text.split("\n") if words_of(line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    chars = sum(len(w.decode()) for w in words)
    assert H.measure(text.encode()) == (len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines), dup, len(covered))


def test_hosts_are_shrunk_and_rejected(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "short"
    rows = [(i, good, f"h{i % 10}") for i in range(400)] + [(1000 + i, bad if i else good, "spam") for i in range(40)]
    rows += [(2000, bad, "once"), (2001, good, None), (2001, good, None), (2002, None, None), (2003, "", "h1")]
    rows += [(3000 + i, good, "fine") for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = H.host_rules(docs).collect()
    assert len(got) == len(rows)
    kept = defaultdict(list)
    for r in got:
        kept[r.doc_id].append(r.kept)
    assert kept[1000] == [False]  # good, but from a rejected host
    assert kept[2001] == [True, True] and kept[3000] == [True] and kept[5] == [True]
    assert kept[2000] == kept[2002] == kept[2003] == [False]
    rates = {r.host: r.host_rate for r in got}
    assert rates["once"] < 0.99 and rates["spam"] > 0.5
    assert H.host_rules(spark.createDataFrame([], SCHEMA)).collect() == []


# ---- decontamination ------------------------------------------------------------


def brute_hits(text, items):
    words, found = text.encode().lower().split(), {}
    for item_id, item in items:
        own = (item or "").encode().lower().split()
        if len(own) < 5:
            continue
        count = lambda w: Counter(b" ".join(w[i : i + 5]) for i in range(len(w) - 4))
        want = count(own)
        for s in range(max(1, len(words) - len(own) + 1)):
            have = count(words[s : s + len(own)])
            same = (want & have).total() / max(1, (want | have).total())
            if same >= 0.8:
                found[item_id] = max(found.get(item_id, 0), same)
    return found


def test_windows_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(25)]
    items += [(90, "too short item"), (91, None), (92, ""), (93, "go go go go go go go go go go"), (94, items[0][1])]
    docs = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(0, 120))]
        if i % 2:
            part = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(part))
                edit = rng.choice(("drop", "add", "swap"))
                part[at : at + (edit != "add")] = [] if edit == "drop" else [word()]
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words)))
    docs += [(500, None), (501, ""), (502, "go " * 300), (503, items[3][1]), (503, items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("mine"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = D.decontamination_hits(frame, bench).collect()
    by_doc = defaultdict(dict)
    for r in got:
        by_doc[r.doc_id][r.item_id] = r.similarity
        assert r.distance <= D.RADIUS
    assert sum(r.doc_id == 503 for r in got) == 2
    for d, text in docs:
        assert by_doc[d] == pytest.approx(brute_hits(text or "", items)), d
    assert len(by_doc) > 40
    several = D.contaminated(frame, bench, pass_bytes=400).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id")
    assert sorted(several.collect()) == sorted((r.doc_id, r.item_id) for r in got)
    assert D.decontamination_hits(frame, bench.limit(0)).collect() == []
    assert D.decontamination_hits(frame.limit(0), bench).collect() == []


def test_reordered_passages_inside_longer_texts(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice((40, 60, 90, 150))))) for i in range(20)]
    docs = []
    for i in range(60):
        part = items[i % 20][1].split()
        cuts = sorted(rng.sample(range(1, len(part)), 1 if len(part) < 90 else rng.randint(1, 2)))
        pieces = [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]
        around = [[word() for _ in range(rng.randint(0, 200))] for _ in range(2)]
        docs.append((i, " ".join(around[0] + [w for piece in reversed(pieces) for w in piece] + around[1])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    by_doc = defaultdict(dict)
    for r in D.decontamination_hits(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect():
        by_doc[r.doc_id][r.item_id] = r.similarity
    for d, text in docs:
        assert by_doc[d] == pytest.approx(brute_hits(text, items)), d
    assert sum(map(len, by_doc.values())) > 50


def test_index_finds_every_fingerprint_within_the_radius():
    rng = random.Random(2)
    texts = [" ".join(f"{rng.random():.3f}" for _ in range(30)) for _ in range(200)]
    index = D.Items([(i, t.encode()) for i, t in enumerate(texts)])
    prints = [x[2] for x in index.items]
    for _ in range(300):
        probe = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, 24)):
            probe ^= 1 << b
        want = {i for i, p in enumerate(prints) if (p ^ probe).bit_count() <= D.RADIUS}
        assert {i for i, _ in index.within(30, probe)} == want


# ---- language model ---------------------------------------------------------------


def test_scores_against_plain_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(150)
    extra = [(None, "A lone Text"), (7_000_001, None), (7_000_002, ""), (7_000_003, "same same"), (7_000_003, "same same")]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = [(d, [*(t or "").encode().lower().split(), b""]) for d, t in rows]
    count = Counter(w for d, t in tokens if not held(d) for w in t)
    n, v = sum(count.values()), len(count)
    base = sorted(
        (d if d is not None else -1, held(d), len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        for d, t in tokens
    )
    # With all words sent, with so few that most travel on, and with none: the same counts and scores.
    scores = {}
    for head_words in (1 << 18, 5, 0):
        got = L.lm_scores(docs, head_words=head_words).collect()
        own = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
        assert [o[:5] for o in own] == [b[:5] for b in base]
        assert [o[5] for o in own] == pytest.approx([b[5] for b in base])
        better = [r for r in got if r.held_out]
        assert sum(r.score for r in better) > sum(r.base_score for r in better)
        assert all(r.score <= 0 for r in got)
        scores[head_words] = sorted(r.score for r in got)
    assert scores[5] == pytest.approx(scores[1 << 18]) and scores[0] == pytest.approx(scores[1 << 18])
    assert L.lm_scores(docs.limit(0)).collect() == []


def test_mixture_is_a_distribution_and_matches_counts(spark):
    """Scores of one-word texts are log10 of the mixture worked out by hand, and sum to one."""
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a b", "b a a", "c c a b", "a", "b b c"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shown = {}
    weights = L.learn_weights

    def spy(*args):
        shown["w"] = weights(*args)
        return shown["w"]

    L.learn_weights = spy
    try:
        got = {r.doc_id: r for r in L.lm_scores(docs).collect()}
    finally:
        L.learn_weights = weights
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    single, double = Counter(), Counter()
    for d, t in rows:
        if not held(d):
            w = ["", *t.split(), ""]
            single.update(w[1:])
            double.update(zip(w, w[1:]))
    n, v = sum(single.values()), len(single)

    def p(a, b):
        w = shown["w"][int(math.log2(single[a] + 1))]
        return w[0] * double[a, b] / single[a] + w[1] * single[b] / n + w[2] / (v + 1)

    for d, t in rows:
        w = ["", *t.split(), ""]
        assert got[d].score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(w, w[1:])), rel=1e-5)
    rest = shown["w"][int(math.log2(single["a"] + 1))][2] / (v + 1)  # the place of words never seen
    assert sum(p("a", b) for b in single) + rest == pytest.approx(1)


def test_weights_follow_the_evidence():
    code = lambda bucket, bi, uni: (bucket * L.LEVELS + int(L._bin(np.array([bi]))[0])) * L.LEVELS + int(L._bin(np.array([uni]))[0])
    bins = np.array([code(3, 0.5, 0.01), code(3, 0.0, 0.01), code(9, 0.5, 0.01), code(9, 0.0, 0.01)])
    w = L.learn_weights(bins, np.array([1.0, 99.0, 90.0, 10.0]), 1e-6)
    assert w[9][0] > 0.85 and w[3][0] < 0.05
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w[0], w[20])


# ---- quality ----------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (0, "", "xx", "", 0)], docs.schema)
    got = Q.quality(docs.union(odd), labels.withColumn("text", F.lit(1))).collect()
    assert len(got) == docs.count() + 2 and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.kept == (y == 1) for r, y in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got if r.doc_id is not None)
    one_kind = Q.quality(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in one_kind} == {1.0}
    assert {r.score for r in Q.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality(docs.limit(0), labels).collect() == []


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.5).astype(np.int64)
    views = [np.where(y[:, None] == 1, 1.2, -1.2) + rng.normal(0, 1.5, (4000, 3)) for _ in range(2)]
    labels = np.where(np.arange(4000) < 60, y, -1)
    train, calibrate = np.arange(4000) < 30, (np.arange(4000) >= 30) & (np.arange(4000) < 60)
    model = Q.co_train(views, labels, train, calibrate)
    odds = np.stack([Q.log_odds(s, Q.log_odds(m, x)[:, None]) for s, m, x in zip(model["scales"], model["models"], views)], axis=1)
    both = Q.log_odds(model["both"], odds)
    accuracy = lambda x: ((x > 0) == (y == 1))[60:].mean()
    assert accuracy(both) > 0.93 and accuracy(both) > max(accuracy(odds[:, 0]), accuracy(odds[:, 1]))


def _plain_co_train(views, labels, train, calibrate, pool):
    """Co-training row by row: every unlabelled row remembers what it was labelled for either view."""
    odds_of = lambda m, s, x: float(Q.log_odds(s, Q.log_odds(m, x[None])[:, None])[0])
    n = len(pool[0])
    given = [[-1] * n for _ in views]
    everything = [np.vstack([v, p]) for v, p in zip(views, pool)]
    models = [{"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-6, "beta": np.zeros(x.shape[1] + 1)} for x in everything]
    sure, prior = np.log(Q.SURE / (1 - Q.SURE)), labels[calibrate].mean()
    for step in range(Q.ROUNDS + 1):
        for v in (0, 1):
            at = [i for i in range(n) if given[v][i] >= 0]
            x = np.vstack([views[v][train], pool[v][at]])
            y = np.concatenate([labels[train], [given[v][i] for i in at]])
            z = np.hstack([np.clip((x - models[v]["mean"]) / models[v]["scale"], -6, 6), np.ones((len(x), 1))])
            penalty = np.diag([Q.RIDGE] * (z.shape[1] - 1) + [1e-6])
            beta = models[v]["beta"]
            for _ in range(Q.STEPS if step else 20):
                p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                beta = beta + np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta), -5, 5)
            models[v] = {**models[v], "beta": beta}
        scales = [Q.fit_logistic(Q.log_odds(m, x[calibrate])[:, None], labels[calibrate], ridge=1e-3) for m, x in zip(models, views)]
        if step == Q.ROUNDS:
            return models, scales, given
        for own, other in ((0, 1), (1, 0)):
            open_ = [i for i in range(n) if given[own][i] < 0]
            bins = {i: min(Q.BINS - 1, max(0, int((odds_of(models[other], scales[other], pool[other][i]) + 15) / 30 * Q.BINS))) for i in open_}
            ranked = sorted(bins.values(), reverse=True)
            for label, order, share in ((1, ranked, prior), (0, ranked[::-1], 1 - prior)):
                most = max(1.0, Q.SHARE * n * share)
                if not order:
                    continue
                edge = order[min(len(order), int(np.ceil(most))) - 1]
                for i in open_:
                    surely = bins[i] >= np.ceil((sure + 15) / 30 * Q.BINS) if label else bins[i] <= Q.BINS - 1 - np.ceil((sure + 15) / 30 * Q.BINS)
                    if given[own][i] < 0 and surely and (bins[i] >= edge if label else bins[i] <= edge):
                        given[own][i] = label


def test_co_training_against_plain_rows():
    rng = np.random.default_rng(3)
    y = (rng.random(1500) < 0.4).astype(np.int64)
    views = [np.where(y[:, None] == 1, 1.0, -1.0) + rng.normal(0, 1.2, (1500, k)) for k in (3, 2)]
    labels, train = y[:80], np.arange(80) < 50
    models, scales, given = _plain_co_train([v[:80] for v in views], labels, train, ~train, [v[80:] for v in views])
    got = Q.co_train([v[:80] for v in views], labels, train, ~train, Q.Rows([v[80:] for v in views]))
    assert sum(g >= 0 for g in given[0]) > 100 and sum(g >= 0 for g in given[1]) > 50
    for v in (0, 1):
        assert got["models"][v]["beta"] == pytest.approx(models[v]["beta"], abs=1e-6)
        assert got["scales"][v]["beta"] == pytest.approx(scales[v]["beta"], abs=1e-6)


def test_every_unlabelled_row_can_take_part(spark):
    """20,000 unlabelled rows in a table give the classifiers that they give at hand, and what gets labels grows with them."""
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "river", "ran", "calmly", "over", "stones"]) for _ in range(rng.randint(30, 60))) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "!!", "win", "$$$", "now", "|"]) for _ in range(rng.randint(3, 15)))
    rows = [(i, good(), "en", f"s{rng.randint(0, 4)}") if rng.random() < 0.6 else (i, bad(), rng.choice(["en", "xx"]), f"s{rng.randint(4, 8)}") for i in range(20_300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6).withColumn("n_chars", F.length("text").cast("long"))
    measured = Q.saved(Q._measured(docs, "doc_id", "text"), "measured")
    table, at_hand = Q.Table(measured.where("doc_id >= 300")), Q.Rows(Q._views(measured.where("doc_id >= 300").orderBy("doc_id").toArrow()))
    labelled = measured.where("doc_id < 300").orderBy("doc_id").toArrow()
    label = np.array([int("." in rows[i][1]) for i in labelled.column("doc_id").to_pylist()])
    fold = np.arange(300) % 4 > 0
    one, other = (Q.co_train(Q._views(labelled), label, fold, ~fold, pool) for pool in (table, at_hand))
    for v in (0, 1):
        assert one["models"][v]["beta"] == pytest.approx(other["models"][v]["beta"], abs=1e-4)
    state = {}
    inner = Q.sureness
    seen = lambda views, s: state.update(s) or inner(views, s)
    Q.sureness = seen
    try:
        Q.co_train(Q._views(labelled), label, fold, ~fold, at_hand)
    finally:
        Q.sureness = inner
    assert sum((Q._given(state["history"][v], at_hand.views, 1 - v) >= 0).sum() for v in (0, 1)) > 2_000
