"""Toxic spans by a linear-chain conditional random field.

Tokens are tagged toxic or not; a line is a chain. Token labels for training
come from document labels: in toxic documents, those tokens count as toxic that
carry a word or affix far commoner in toxic than in other labelled documents.
Marginals from forward-backward give spans, and their sum and maximum give the
document's score through a logistic calibration on the document labels.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_batches, remainder, saved, shingles, with_fields

# ---- parameters --------------------------------------------------------------
#: The classifier is fitted on at most so many labelled rows of either class.
MAX_TOXIC = 2_000
MAX_CLEAN = 3_000
#: A longer text teaches the tagger by lines from anywhere in it, so many bytes in all; the calibration sees it whole.
EXCERPT_BYTES = 20_000
PIECE_WORDS = 100
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
BUCKETS = 1 << 18
MIN_RATIO = 20.0
FALSE_MARKS = 0.1
EPOCHS = 30
RATE = 0.5
L2 = 1e-6
SPAN_MARGINAL = 0.5
CACHE = 250_000
# ------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = b".,;:!?\"'()[]{}*#$%&|-"


def token_features(token: bytes) -> list[bytes]:
    """The word without punctuation at its ends, three prefixes and a suffix."""
    word = token.lower().strip(EDGES).decode("utf-8", "replace")
    parts = [("w", word)] + [(f"p{n}", word[:n]) for n in (4, 5, 6) if len(word) > n]
    if len(word) > 4:
        parts.append(("s4", word[-4:]))
    return [f"{kind}={value}".encode() for kind, value in parts]


def _buckets(token: bytes) -> list[int]:
    return [xxhash.xxh64_intdigest(f) % BUCKETS for f in token_features(token)]


def _lines(text: bytes) -> list[list[bytes]]:
    return [words for words in (line.split() for line in text.split(b"\n")) if words]


class Chains:
    """Token positions of many chains, walked step by step over all at once."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.starts = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        longest = int(sorted_lengths[0]) if len(lengths) else 0
        ascending = sorted_lengths[::-1]
        self.active = len(lengths) - np.searchsorted(ascending, np.arange(longest), side="right")

    def marginals(self, emission: np.ndarray, start: float, move: np.ndarray, pairs: bool = False):
        """P(toxic) per token; with ``pairs`` also the expected counts of the four moves.

        ``start`` and ``emission`` are log-odds for the toxic tag, ``move[i, j]``
        the log weight of tag i before tag j. Messages are kept as ratios, which
        cannot overflow once clipped.
        """
        t = np.exp(move)
        odds = np.exp(np.clip(emission, -30, 30))
        forward, backward = np.empty_like(odds), np.ones_like(odds)
        for step, k in enumerate(self.active):
            at = self.starts[:k] + step
            if step:
                r = forward[at - 1]
                ratio = (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)
            else:
                ratio = np.exp(start)
            forward[at] = odds[at] * ratio
        for step in range(len(self.active) - 2, -1, -1):
            at = self.starts[: self.active[step + 1]] + step
            after = odds[at + 1] * backward[at + 1]
            backward[at] = (t[1, 0] + t[1, 1] * after) / (t[0, 0] + t[0, 1] * after)
        both = forward * backward
        p = both / (1 + both)
        if not pairs:
            return p
        inner = np.ones(len(odds), bool)
        inner[self.starts] = False
        at = np.nonzero(inner)[0]
        r, after = forward[at - 1], odds[at] * backward[at]
        all_moves = t[0, 0] + t[0, 1] * after + t[1, 0] * r + t[1, 1] * r * after
        shares = ((1 / all_moves).sum(), (after / all_moves).sum(), (r / all_moves).sum(), (r * after / all_moves).sum())
        return p, t * np.array(shares).reshape(2, 2), at


class Encoded:
    """Texts as numbers: token ids, line lengths and token counts, and the features of each distinct token."""

    def __init__(self, texts: list[bytes]):
        known: dict[bytes, int] = {}
        ids, self.lines, self.counts = [], [], []
        for text in texts:
            own = _lines(text)
            self.lines += map(len, own)
            self.counts.append(sum(map(len, own)))
            ids.append(np.fromiter((known.setdefault(w, len(known)) for line in own for w in line), np.int32))
        self.ids = np.concatenate([np.zeros(0, np.int32), *ids])
        self.lines = np.array(self.lines, np.int64)
        self.features = np.zeros((len(known), 5), np.uint64)  # zero: no feature
        for w, i in known.items():
            hashes = [xxhash.xxh64_intdigest(f) for f in token_features(w)]
            self.features[i, : len(hashes)] = hashes

    def documents(self) -> list[np.ndarray]:
        return np.split(self.ids, np.cumsum(self.counts)[:-1])


def _weights_at(features: np.ndarray) -> np.ndarray:
    """Where the features' weights are; a missing feature is at the end, where the weight stays zero."""
    return np.where(features == 0, BUCKETS, features % np.uint64(BUCKETS)).astype(np.int32)


def fit_tagger(data: Encoded, tags: np.ndarray) -> dict:
    """Weights by gradient ascent (Adagrad) on the conditional likelihood of ``tags``."""
    ids, at, n = data.ids, _weights_at(data.features), len(data.features)
    chains = Chains(data.lines)
    weight, bias, move, start = np.zeros(BUCKETS + 1), -3.0, np.zeros((2, 2)), 0.0
    _, _, inner = chains.marginals(np.zeros(len(ids)), 0.0, move, pairs=True)
    seen_moves = np.bincount(tags[inner - 1] * 2 + tags[inner], minlength=4).reshape(2, 2)
    memory, move_memory, bias_memory = np.full(BUCKETS + 1, 1e-8), np.full((2, 2), 1e-8), 1e-8
    scale = 1.0 / max(1, int(tags.sum()))
    for _ in range(EPOCHS):
        emission = weight[at].sum(axis=1)[ids] + bias
        p, moves, _ = chains.marginals(emission, start, move, pairs=True)
        error = tags - p
        per_word = np.bincount(ids, error, n)
        gradient = np.bincount(at.ravel(), np.repeat(per_word, at.shape[1]), BUCKETS + 1) * scale - L2 * weight
        gradient[BUCKETS] = 0.0
        memory += gradient**2
        weight += RATE * gradient / np.sqrt(memory)
        change = (seen_moves - moves) * scale
        move_memory += change**2
        move = np.clip(move + 0.2 * RATE * change / np.sqrt(move_memory), -5, 5)
        slope = float(error.sum()) * scale
        bias_memory += slope**2
        bias += 0.2 * RATE * slope / bias_memory**0.5
    return {"weight": weight[:BUCKETS].astype(np.float32), "bias": bias, "move": move, "start": start}


class Tagger:
    """Scores batches of texts; emissions of words are kept in a bounded cache."""

    def __init__(self, model: dict):
        self.model, self.cache = model, {}

    def emission(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, weight, bias = self.cache, self.model["weight"], self.model["bias"]
        for w in set(tokens).difference(cache):
            cache[w] = bias + float(weight[_buckets(w)].sum())
        return np.fromiter(map(cache.__getitem__, tokens), np.float64, len(tokens))

    def marginals(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text, P(toxic) of its tokens in order."""
        lines, counts = [], []
        for text in texts:
            own = _lines(text)
            lines += own
            counts.append(sum(map(len, own)))
        tokens = [w for line in lines for w in line]
        if not tokens:
            return [np.zeros(0)] * len(texts)
        chains = Chains(np.fromiter(map(len, lines), np.int64, len(lines)))
        p = chains.marginals(self.emission(tokens), self.model["start"], self.model["move"])
        return np.split(p, np.cumsum(counts)[:-1])


def _surprise(n: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    """Bound on -log of the chance that ``n`` or more of ``n + other`` draws fall to a class of ``share``."""
    total = np.maximum(n + other, 1)
    rate = n / total
    rest = np.where(other > 0, (1 - rate) * np.log(np.maximum(1 - rate, 1e-12) / (1 - share)), 0.0)
    return np.where(rate > share, total * (rate * np.log(np.maximum(rate, 1e-12) / share) + rest), 0.0)


def _summary(p: np.ndarray) -> tuple[float, ...]:
    """Largest and second largest marginal and the expected number of toxic tokens."""
    second, first = np.partition(np.concatenate([[0.0, 0.0], p]), -2)[-2:]
    return 1.0, float(first), float(second), float(np.log1p(p.sum()))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(hessian, x.T @ (w * (y - p)) - ridge * beta)
    return beta


def excerpt(text: bytes) -> bytes:
    """The text, or of a long one lines, or pieces of long lines, drawn from all of it and kept in order."""
    if len(text) <= EXCERPT_BYTES:
        return text
    pieces = [b" ".join(line[at : at + PIECE_WORDS])[:EXCERPT_BYTES] for line in _lines(text) for at in range(0, len(line), PIECE_WORDS)]
    order = list(range(len(pieces)))
    random.Random(len(text)).shuffle(order)
    chosen, left = [], EXCERPT_BYTES
    for k in order:
        if len(pieces[k]) <= left:
            chosen.append(k)
            left -= len(pieces[k]) + 1
    return b"\n".join(pieces[k] for k in sorted(chosen))


def fit(kept: list[tuple[bytes, int]], toxic_share: float) -> dict:
    """The tagger from ``(excerpt, label)`` rows; with labels of one kind only, every score is their share."""
    labels = np.array([label for _, label in kept], np.int64)
    if len(set(labels.tolist())) < 2:
        return {"constant": float(labels.mean()) if len(labels) else 0.0}
    data = Encoded([text for text, _ in kept])
    names, features = np.unique(data.features, return_inverse=True)
    features = features.reshape(data.features.shape)
    counts = np.zeros((2, len(names)))
    for ids, label in zip(data.documents(), labels):
        counts[label, np.unique(features[np.unique(ids)])] += 1
    clean, toxic = counts
    n_toxic, n_clean = int(labels.sum()), int((1 - labels).sum())
    # Few of so many features are this one-sided by chance; a lone wrong mark is left to the calibration.
    limit = np.log(FALSE_MARKS * max(1, int((toxic > 0).sum())))
    marks = (toxic / n_toxic >= MIN_RATIO * (clean + 0.1) / n_clean) & (_surprise(toxic, clean, n_toxic / len(labels)) >= limit)
    marks &= (names != 0) & (toxic > 0)
    marked = marks[features].any(axis=1)
    tags = marked[data.ids].astype(np.int64) * np.repeat(labels, data.counts)
    if not tags.any():
        return {"constant": float(toxic_share)}
    return fit_tagger(data, tags)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Fits on labelled rows outside the held-out fold, a bounded sample drawn by a hash of the id.

    Null ids and labels other than 0 and 1 are left out; of repeated ids the largest label counts.
    Near copies (equal least shingle hash) are trained on once, so that one
    copied text does not make its own words look toxic. Tasks read the texts
    whole; the driver gets excerpts for the tagger and three numbers a text for
    the calibration, which is corrected for the sample's balance.
    """
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    shares = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    drawn = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
        for label, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))
    ]
    sample = drawn[0].union(drawn[1])  # at most MAX_TOXIC + MAX_CLEAN rows of two numbers
    texts = docs.select(docs[id_col].cast("long").alias("label_id"), docs[text_col].cast("string").alias("text"))
    texts = texts.where("text is not null").join(F.broadcast(sample), "label_id")
    texts = saved(texts.groupBy("label_id").agg(F.min(F.struct("text", "toxic")).alias("row")).select("label_id", "row.*"), "labelled")

    def cut(batches):
        for batch, raw in chunks(batches, "text"):
            keys = [min((xxhash.xxh64_intdigest(x) for x in shingles(t.lower().split(), 5)), default=0) for t in raw]
            columns = [batch.column("label_id"), batch.column("toxic"), pa.array([f"{k:x}" for k in keys]), pa.array(map(excerpt, raw), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label_id", "toxic", "key", "excerpt"])

    kept: dict[tuple[str, int], tuple[int, bytes]] = {}
    for r in sorted(map_batches(texts, "label_id long, toxic int, key string, excerpt binary", cut).collect()):
        kept.setdefault((r["key"], r["toxic"]), (r["label_id"], bytes(r["excerpt"])))
    share = shares[1] / max(1, shares[0])
    model = fit([(text, label) for (_, label), (_, text) in kept.items()], share)
    if "constant" in model:
        return model
    of = {label_id: label for (_, label), (label_id, _) in kept.items()}
    kept.clear()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def summaries(batches):
        tagger = Tagger(shared.value)
        for batch, raw in chunks(batches, "text"):
            found = pa.array([_summary(p) for p in tagger.marginals(raw)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("label_id"), found], ["label_id", "x"])

    rows = sorted((r["label_id"], r["x"]) for r in map_batches(texts, "label_id long, x array<double>", summaries).collect() if r["label_id"] in of)
    labels = np.array([of[label_id] for label_id, _ in rows], np.int64)
    n_toxic, n_clean = int(labels.sum()), int((1 - labels).sum())
    weight = np.where(labels == 1, share / n_toxic, (1 - share) / n_clean) * len(labels)
    return model | {"beta": _logistic(np.array([x for _, x in rows]), labels, weight)}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score", spans_col: str = "spans") -> DataFrame:
    """All columns of ``docs`` plus a score in 0 .. 1 and the toxic spans ``(start, end)`` in characters.

    Null and wordless texts score as texts without toxic tokens. Columns of
    ``docs`` with the new names are replaced.
    """
    docs = docs.drop(score_col, spans_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        tagger = None if "constant" in fitted else Tagger(fitted)
        for batch, texts in chunks(batches, text_col):
            scores, spans = [], []
            if tagger is None:
                scores, spans = [fitted["constant"]] * len(texts), [[] for _ in texts]
            else:
                marginals = tagger.marginals(texts)
                x = np.array([_summary(p) for p in marginals]).reshape(-1, 4)
                scores = 1 / (1 + np.exp(-np.clip(x @ fitted["beta"], -30, 30)))
                spans = [_spans(text, p) for text, p in zip(texts, marginals)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, score_col, spans_col])

    return map_batches(docs, with_fields(docs, **{score_col: "double", spans_col: "array<struct<start:int,end:int>>"}), run)


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Neighbouring toxic tokens of a line are one span."""
    if not (p > SPAN_MARGINAL).any():
        return []
    spans, whole, open_at = [], text.decode("utf-8", "replace"), None
    for found, value in zip(WORD.finditer(whole), p):
        if value > SPAN_MARGINAL:
            if open_at == found.start() - 1 and whole[open_at] != "\n":
                spans[-1]["end"] = found.end()
            else:
                spans.append({"start": found.start(), "end": found.end()})
            open_at = found.end()
    return spans


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` for every row of ``docs``; repeated rows stay."""
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = score(rows, model)
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )
