"""Quality classifier by co-training on two views of a document.

One classifier sees measures of the text, the other what is known about the
page (length, language, source). Both start from the labelled rows. In every
round each labels the unlabelled rows it is surest of, and these become training
rows of the other. Each view is then calibrated on labelled rows that neither
was trained on, and the calibrated log-odds are weighted together.

Every unlabelled row takes part. The features of all rows are written once; what
a row was labelled, and in which round, follows from the classifiers of the
rounds so far, so tasks need only these few numbers. They hand back sums: the
gradient and Hessian of rows labelled so far, and histograms of how sure a view
is of the others, from which the next threshold is read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import broadcast_if_small
from .common import chunks, map_batches, remainder, saved

# ---- parameters --------------------------------------------------------------
#: The classifiers start from at most so many labelled rows of either class.
MAX_LABELLED = 4_000
FOLDS, HELD_OUT, CALIBRATION = 5, 1, 2
ROUNDS = 8
#: The share of all unlabelled rows that a view labels in a round, the classes in
#: proportion, and how sure it must be. Rows that are equally sure go together.
SHARE = 1 / 80
SURE = 0.95
#: Steps of Newton's method from the classifier of the round before.
STEPS = 3
#: How finely rows are told apart by how sure a view is.
BINS = 1 << 14
RIDGE = 1.0
THRESHOLD = 0.5
LANG_SLOTS, SOURCE_SLOTS = 16, 64
# ------------------------------------------------------------------------------

SYMBOLS = re.compile(rb"[#*$%&|<>{}\\^~=_@]")
TEXT_FEATURES = 18


def text_features(text: bytes) -> list[float]:
    """Eighteen measures of a text; all are zero where there are no words."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * TEXT_FEATURES
    chars = text.decode("utf-8", "replace")
    counts = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = sum(map(str.isalpha, chars)) or 1
    top = counts.most_common(1)[0][1]
    return [
        np.log1p(n),
        np.log1p(size / n),
        len(SYMBOLS.findall(text)) / n,
        text.count(b"|") / n,
        text.count(b"!") / n,
        sum(map(str.isupper, chars)) / letters,
        sum(map(str.isdigit, chars)) / size,
        (sum(w[-1:] in b".!?" for w in words)) / n,
        text.count(b",") / n,
        len(counts) / n,
        top / n if n > 20 else 0.0,
        sum(c for c in windows.values() if c > 1) / max(1, n - 2),
        1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        sum(len(w) == 1 for w in words) / n,
        sum(len(w) > 14 for w in words) / n,
        float(n < 20),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = RIDGE) -> dict:
    """Ridge logistic regression on clipped standard scores, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
    weight = np.ones(len(y)) if weight is None else weight
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    beta = np.zeros(z.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -5, 5)
    return {"mean": mean, "scale": scale, "beta": beta}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return np.clip(z @ model["beta"][:-1] + model["beta"][-1], -15, 15)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


# ---- co-training ---------------------------------------------------------------


def _scored(model: dict, scale: dict, x: np.ndarray) -> np.ndarray:
    """The bin of a view's calibrated log-odds, 0 to BINS - 1."""
    odds = log_odds(scale, log_odds(model, x)[:, None])
    return np.clip(np.floor((odds + 15) / 30 * BINS), 0, BINS - 1).astype(np.int64)


def _given(history: list, views: list[np.ndarray], teacher: int) -> np.ndarray:
    """What the rounds so far have labelled the rows for the view that ``teacher`` teaches; -1 for nothing."""
    label = np.full(len(views[teacher]), -1)
    for model, scale, least, most in history:
        at = _scored(model, scale, views[teacher])
        label[(label < 0) & (at >= least)] = 1
        label[(label < 0) & (at <= most)] = 0
    return label


def _standard(model: dict, x: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - model["mean"]) / model["scale"], -6, 6), np.ones((len(x), 1))])


def _slopes(model: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the log-likelihood, in one row of numbers."""
    z = _standard(model, x)
    p = _sigmoid(np.clip(z @ model["beta"], -30, 30))
    return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])


def moments(views: list[np.ndarray], _) -> list[np.ndarray]:
    return [np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]) for x in views]


def slopes(views: list[np.ndarray], state) -> list[np.ndarray]:
    """Per view what the rows labelled for it add."""
    out = []
    for own, other in ((0, 1), (1, 0)):
        y = _given(state["history"][own], views, other)
        out.append(_slopes(state["models"][own], views[own][y >= 0], y[y >= 0]))
    return out


def sureness(views: list[np.ndarray], state) -> list[np.ndarray]:
    """Per view a histogram of how sure its teacher is of the rows that have no label for it."""
    out = []
    for own, other in ((0, 1), (1, 0)):
        open_ = _given(state["history"][own], views, other) < 0
        out.append(np.bincount(_scored(state["models"][other], state["scales"][other], views[other][open_]), minlength=BINS).astype(float))
    return out


class Rows:
    """Unlabelled rows at hand."""

    def __init__(self, views: list[np.ndarray]):
        self.views = views

    def add(self, kernel, state=None) -> list[np.ndarray]:
        return kernel(self.views, state)


def _thresholds(counts: np.ndarray, wanted: float, prior: float) -> tuple[int, int]:
    """The least bin that is labelled 1 and the last that is labelled 0."""
    sure = int(np.ceil((np.log(SURE / (1 - SURE)) + 15) / 30 * BINS))
    above = np.cumsum(counts[::-1])[::-1]
    enough = np.flatnonzero(above >= max(1.0, wanted * prior))
    least = max(sure, int(enough[-1]) if len(enough) else 0)
    below = np.cumsum(counts)
    enough = np.flatnonzero(below >= max(1.0, wanted * (1 - prior)))
    return least, min(BINS - 1 - sure, int(enough[0]) if len(enough) else BINS - 1)


def co_train(views: list[np.ndarray], labels: np.ndarray, train: np.ndarray, calibrate: np.ndarray, pool=None) -> dict:
    """``views``: one feature matrix per view, same rows; ``labels``: 1, 0 or -1 for unlabelled.

    ``pool`` stands for unlabelled rows elsewhere: ``pool.add(kernel, state)`` gives the sums of ``kernel`` over them.
    """
    if len(set(labels[labels >= 0].tolist())) < 2:
        return {"constant": float(labels[labels >= 0].mean()) if (labels >= 0).any() else 0.5}
    if pool is None:
        pool = Rows([x[labels < 0] for x in views])
    views, train, calibrate, labels = [x[labels >= 0] for x in views], train[labels >= 0], calibrate[labels >= 0], labels[labels >= 0]
    if len(set(labels[train].tolist())) < 2:
        train = np.ones(len(labels), bool)
    if len(set(labels[calibrate].tolist())) < 2:
        calibrate = np.ones(len(labels), bool)
    prior = labels[calibrate].mean()
    known = [x[train] for x in views]
    sums = [a + b for a, b in zip(moments(views, None), pool.add(moments))]
    models, n_pool = [], sums[0][0] - len(labels)
    for x, total in zip(views, sums):
        mean, square = np.split(total[1:] / total[0], 2)
        models.append({"mean": mean, "scale": np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6, "beta": np.zeros(x.shape[1] + 1)})
    history: list[list] = [[], []]
    for step in range(ROUNDS + 1):
        for _ in range(STEPS if any(history) else 20):
            added = pool.add(slopes, {"models": models, "history": history}) if any(history) else [0.0, 0.0]
            for v, more in enumerate(added):
                total = _slopes(models[v], known[v], labels[train]) + more
                d = len(models[v]["beta"])
                penalty = np.full(d, RIDGE)
                penalty[-1] = 1e-6
                slope, bend = total[:d] - penalty * models[v]["beta"], total[d:].reshape(d, d) + np.diag(penalty)
                models[v] = {**models[v], "beta": models[v]["beta"] + np.clip(np.linalg.solve(bend, slope), -5, 5)}
        # Sure is what holds after calibration: a weak view then labels little.
        scales = [fit_logistic(log_odds(m, x[calibrate])[:, None], labels[calibrate], ridge=1e-3) for m, x in zip(models, views)]
        if step == ROUNDS or n_pool < 1:
            break
        counts = pool.add(sureness, {"models": models, "scales": scales, "history": history})
        for own, other in ((0, 1), (1, 0)):
            history[own].append((models[other], scales[other], *_thresholds(counts[own], SHARE * n_pool, prior)))
    odds = np.stack([log_odds(s, log_odds(m, x[calibrate])[:, None]) for s, m, x in zip(scales, models, views)], axis=1)
    both = fit_logistic(odds, labels[calibrate], ridge=1e-2)
    return {"models": models, "scales": scales, "both": both}


# ---- over all documents ----------------------------------------------------------


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows that are needed, with absent page columns as nulls."""
    column = lambda name, kind: (docs[name] if name in docs.columns else F.lit(None)).cast(kind).alias(name)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
        column("n_chars", "long"), column("lang", "string"), column("source", "string"),
    )


TEXT = [f"t{i}" for i in range(TEXT_FEATURES)]
PAGE = ["n_chars", "lang_slot", "source_slot"]
SCHEMA = "doc_id long, " + ", ".join(f"{name} double" for name in TEXT) + ", n_chars double, lang_slot int, source_slot int"


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The features of every row: those of the text, and of the page as three numbers."""

    def run(batches):
        for batch, texts in chunks(batches, "text"):
            text = np.array([text_features(t) for t in texts], np.float64).reshape(-1, TEXT_FEATURES)
            chars = [float(max(n or 0, 0)) for n in batch.column("n_chars").to_pylist()]
            slots = [
                [xxhash.xxh64_intdigest(f"{name} {value}") % size for value in batch.column(name).to_pylist()]
                for name, size in (("lang", LANG_SLOTS), ("source", SOURCE_SLOTS))
            ]
            columns = [batch.column("doc_id"), *(pa.array(c) for c in text.T), pa.array(chars), *(pa.array(c, pa.int32()) for c in slots)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *TEXT, *PAGE])

    return map_batches(_features(docs, id_col, text_col), SCHEMA, run)


def _views(batch) -> list[np.ndarray]:
    """Both views of measured rows."""
    text = np.column_stack([batch.column(c).to_numpy() for c in TEXT])
    chars, lang, source = (batch.column(c).to_numpy() for c in PAGE)
    page = np.zeros((len(chars), 2 + LANG_SLOTS + SOURCE_SLOTS))
    page[:, 0], page[:, 1] = np.log1p(chars), chars < 200
    at = np.arange(len(chars))
    page[at, 2 + lang] = 1.0
    page[at, 2 + LANG_SLOTS + source] = 1.0
    return [text, page]


class Table:
    """Unlabelled rows that Spark holds, measured."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def add(self, kernel, state=None) -> list[np.ndarray]:
        sent = pickle.dumps(state)

        def run(batches):
            state, total = pickle.loads(sent), None
            for batch in batches:
                if batch.num_rows:
                    found = kernel(_views(batch), state)
                    total = found if total is None else [a + b for a, b in zip(total, found)]
            for view, values in enumerate(total or []):
                at = np.flatnonzero(values)
                columns = [pa.array(np.full(len(at), view), pa.int32()), pa.array(at, pa.int32()), pa.array(values[at])]
                yield pa.RecordBatch.from_arrays(columns, ["view", "at", "value"])

        parts = map_batches(self.rows, "view int, at int, value double", run)
        # As many rows as the kernel gives numbers, whatever the number of tasks.
        sums = parts.groupBy("view", "at").agg(F.sum("value").alias("value")).toArrow()
        out = [np.zeros(len(v)) for v in kernel([np.zeros((0, TEXT_FEATURES)), np.zeros((0, 2 + LANG_SLOTS + SOURCE_SLOTS))], state)]
        for view, values in enumerate(out):
            mine = sums.column("view").to_numpy() == view
            values[sums.column("at").to_numpy()[mine]] = sums.column("value").to_numpy()[mine]
        return out


def train(measured: DataFrame, labels: DataFrame) -> dict:
    """Co-trained on a bounded sample of labelled rows, drawn by a hash of the id, and on all rows without label.

    The held-out fold teaches nothing. Features of at most ``2 * MAX_LABELLED``
    documents reach the driver, and sums.
    """
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("of"))
        .agg(F.min("quality").cast("int").alias("label"))
    )
    known = saved(known, "known")
    taught = known.where(remainder(F.col("of"), FOLDS) != HELD_OUT)
    drawn = [taught.where(F.col("label") == y).orderBy(F.xxhash64(F.lit("quality"), "of"), "of").limit(MAX_LABELLED) for y in (0, 1)]
    sample = F.broadcast(drawn[0].union(drawn[1]))
    # A document that is repeated teaches once.
    first = measured.join(sample, F.col("doc_id") == F.col("of")).drop("of").dropDuplicates(["doc_id"])
    found = first.withColumn("fold", remainder(F.col("doc_id"), FOLDS)).orderBy("doc_id").toArrow()
    if not found.num_rows:
        return {"constant": 0.5}
    open_ = measured.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    open_ = open_.join(broadcast_if_small(known.select(F.col("of").alias("doc_id"))), "doc_id", "left_anti")
    label, fold = (found.column(k).to_numpy().astype(np.int64) for k in ("label", "fold"))
    if len(set(label.tolist())) < 2:
        return {"constant": float(label.mean())}
    pool = Table(saved(open_, "pool"))
    return co_train(_views(found), label, fold != CALIBRATION, fold == CALIBRATION, pool)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, text_score, page_score, score, kept)`` for every row of ``docs``.

    Scores are probabilities of quality 1; ``kept`` is a score of a half or more.
    Null texts are empty, null page columns a value of their own; *very long*
    texts are measured whole, a chunk of texts at a time. *Repeated rows* stay
    and, unlabelled, count each. *Ties*: rows a view is equally sure of are
    labelled together. *Other columns* are not read, whatever their names. With
    labels of one kind only, all scores are their share, without any 0.5. An
    empty table gives no rows.
    """
    measured = saved(_measured(docs, id_col, text_col), "measured")
    model = train(measured, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            if "constant" in fitted:
                scores = [np.full(batch.num_rows, fitted["constant"])] * 3
            else:
                odds = [log_odds(s, log_odds(m, x)[:, None]) for s, m, x in zip(fitted["scales"], fitted["models"], _views(batch))]
                scores = [_sigmoid(o) for o in (*odds, log_odds(fitted["both"], np.stack(odds, axis=1)))]
            columns = [batch.column("doc_id"), *(pa.array(s, pa.float64()) for s in scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_score", "page_score", "score"])

    scored = map_batches(measured, "doc_id long, text_score double, page_score double, score double", run)
    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= THRESHOLD).alias("kept"))
