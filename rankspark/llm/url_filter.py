"""URL filters: rules on hosts and paths, and boosted trees on lexical features for what no rule covers.

URLs that a rule covers are the labelled ones, unless a table of labels is given.
All of them train the trees, on all executors; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_counts
from .common import fresh, quoted, saved

# ---- fixed values: the rules of the contract ---------------------------------
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# ------------------------------------------------------------------------------

MAX_RULES = 1_000
TREES = 20
DEPTH = 4
BLOCK_FROM = 0.5
SEED = 7
#: Slots of each table of suffix statistics: an upper bound of what is broadcast.
SLOTS = 1 << 14
#: Weight of the overall rate in the statistics of a suffix.
PRIOR = 10.0

LEXICAL = [
    "url_length", "host_length", "path_length", "depth", "host_labels", "hyphens", "digit_ratio", "letter_ratio", "entropy", "parameters",
]
SUFFIXES = ["top_label", "two_labels", "ending", "folder"]


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    raw = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as it was given; null if none does.

    A rule ``host/path`` fits its host and all subdomains where the path begins
    with the rule's. Of rules of equal length only one can fit, unless one is
    given twice: then the first counts.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; longer lists belong in a table")
    found = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    verdict = F.lit(None).cast("string")
    for name, what in reversed(rules):
        verdict = F.when(rule == name, F.lit(what)).otherwise(verdict)
    return verdict


# ---- features ------------------------------------------------------------------


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text).cast("double")
    counts = term_counts(F.filter(F.split(text, ""), lambda c: c != ""))
    bits = F.aggregate(counts, F.lit(0.0), lambda sum_, c: sum_ - c["tf"] / size * F.log2(c["tf"] / size))
    return F.coalesce(bits, F.lit(0.0))


def lexical_features(url: Column, host: Column, path: Column) -> list[Column]:
    """One column per name of ``LEXICAL``."""
    size = F.length(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    share = lambda pattern: F.coalesce(F.regexp_count(url, F.lit(pattern)) / F.nullif(size, F.lit(0)), F.lit(0.0))
    values = [
        size, F.length(host), F.length(path), F.regexp_count(path, F.lit("[^/]+")), F.regexp_count(host, F.lit(r"[^.]+")),
        F.regexp_count(host, F.lit("-")), share("[0-9]"), share("[A-Za-z]"), _entropy(url), F.regexp_count(query, F.lit("[^&;]+")),
    ]
    return [value.cast("double").alias(name) for name, value in zip(LEXICAL, values)]


def suffixes(host: Column, path: Column) -> list[Column]:
    """The slots of a URL's suffixes, one column per name of ``SUFFIXES``: last label, last two, file ending, first folder."""
    parts = [
        F.regexp_extract(host, r"([^.]*)$", 1),
        F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0),
        F.regexp_extract(path, r"\.([^./]*)$", 1),
        F.regexp_extract(path, r"^/([^/]*)/", 1),
    ]
    return [F.pmod(F.xxhash64(part), F.lit(SLOTS)).cast("int").alias(name) for name, part in zip(SUFFIXES, parts)]


def _suffix_counts(labelled: DataFrame) -> dict[str, DataFrame]:
    """Per kind of suffix: labelled URLs and blocked ones of every slot."""
    counts = F.count(F.lit(1)), F.sum("_label")
    return {name: labelled.groupBy(name).agg(counts[0].alias(f"{name}_n"), counts[1].alias(f"{name}_blocked")) for name in SUFFIXES}


def _with_rates(rows: DataFrame, counts: dict[str, DataFrame], rate: float, own: Column) -> DataFrame:
    """Add what the suffixes say: how often seen and how often blocked.

    ``own`` is the row's label where the row was counted itself, else null: it is left out again.
    """
    counted = own.isNotNull().cast("int")
    for name, table in counts.items():
        # At most SLOTS rows.
        rows = rows.join(F.broadcast(table), name, "left")
        n = F.coalesce(f"{name}_n", F.lit(0)) - counted
        blocked = F.coalesce(f"{name}_blocked", F.lit(0.0)) - F.coalesce(own, F.lit(0.0))
        rows = rows.withColumns({f"{name}_rate": (blocked + PRIOR * rate) / (n + PRIOR), f"{name}_seen": F.log1p(n.cast("double"))})
        rows = rows.drop(f"{name}_n", f"{name}_blocked")
    return rows


FEATURES = LEXICAL + [f"{name}_{what}" for name in SUFFIXES for what in ("rate", "seen")]


class UrlModel:
    """Boosted trees and the suffix statistics they were trained with; a constant where labels are of one kind."""

    def __init__(self, trees, counts: dict[str, DataFrame], rate: float):
        self.trees, self.counts, self.rate = trees, counts, rate

    def probability(self, rows: DataFrame, own: Column, column: str) -> DataFrame:
        """``rows`` with the probability that a URL is to be blocked."""
        if self.trees is None:
            return rows.withColumn(column, F.lit(self.rate))
        with_all = _with_rates(rows, self.counts, self.rate, own)
        judged = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(with_all))
        return judged.withColumn(column, vector_to_array("_probability")[1])


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> UrlModel:
    """Learn from ``labelled``: features, suffix slots and ``_label`` (1.0: block).

    Its rows see the statistics of the others only.
    """
    n, blocked = labelled.agg(F.count(F.lit(1)), F.sum("_label")).first()
    rate = blocked / n if n else 0.0
    if not 0 < rate < 1:
        return UrlModel(None, {}, rate)
    counts = {name: saved(table, f"suffix_{name}") for name, table in _suffix_counts(labelled).items()}
    rows = _with_rates(labelled, counts, rate, F.col("_label"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(rows).select("_vector", "_label")
    learner = GBTClassifier(
        featuresCol="_vector", labelCol="_label", predictionCol="_predicted",
        maxIter=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64,
    )
    return UrlModel(learner.fit(rows).setProbabilityCol("_probability").setRawPredictionCol("_raw"), counts, rate)


def _prepared(rows: DataFrame) -> DataFrame:
    """``(_at, _label, features and slots)`` from ``(_at, _url, _label)``."""
    split = rows.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    host, path = F.col("_host"), F.col("_path")
    return split.select("_at", "_label", *lexical_features(F.col("_url"), host, path), *suffixes(host, path))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``score`` to every row of ``pages``.

    ``labels(url, blocked boolean)`` are the labelled URLs; without them, those of
    ``pages`` that a rule covers. The rule's verdict holds where there is one,
    else the trees': ``block`` from a probability of 0.5. ``score`` is null where
    a rule decides.

    *Nulls*: a null url or one without ``://`` has an empty host and path, is
    covered by no rule and judged by the trees; null labels teach nothing. *Very
    long* urls are read whole. *Ties*: equal urls get equal verdicts. *Repeated
    rows* stay, and each teaches. *Empty table*: no rows; without labels
    everything is allowed, with labels of one kind all get that verdict. *Other
    columns* stay; of those named like a new one the new one's name is lengthened.
    """
    names = {}
    for name in ("host", "path", "rule", "verdict", "score"):
        names[name] = fresh(pages, name)
    inner = [f"_in{i}" for i in range(len(pages.columns))]
    address = F.coalesce(F.col(inner[pages.columns.index(url)]).cast("string"), F.lit(""))
    rows = pages.toDF(*inner).withColumn("_url", address)
    rows = rows.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    rows = rows.withColumn("_rule", matching_rule(F.col("_host"), F.col("_path"), rules))
    rows = rows.withColumn("_ruled", rule_verdict(F.col("_rule"), rules))
    own = (F.col("_ruled") == "block").cast("double")
    if labels is None:
        teaching = rows.where("_ruled is not null").select(F.lit(0).alias("_at"), "_url", own.alias("_label"))
    else:
        teaching = labels.where("blocked is not null").select(
            F.lit(0).alias("_at"), F.coalesce("url", F.lit("")).alias("_url"), F.col("blocked").cast("double").alias("_label")
        )
    model = train(_prepared(teaching))
    host, path = F.col("_host"), F.col("_path")
    rows = rows.withColumns(dict(zip(LEXICAL, [c for c in lexical_features(F.col("_url"), host, path)])))
    rows = rows.withColumns(dict(zip(SUFFIXES, suffixes(host, path))))
    # Rows that a rule covers need no probability; the others were not counted.
    open_ = model.probability(rows.where("_rule is null"), F.lit(None).cast("double"), "_score")
    closed = rows.where("_rule is not null").withColumn("_score", F.lit(None).cast("double"))
    keep = [*inner, "_host", "_path", "_rule", "_ruled", "_score"]
    both = closed.select(*keep).union(open_.select(*keep))
    judged = F.when(F.col("_score") >= BLOCK_FROM, "block").otherwise("allow")
    out = both.select(*inner, "_host", "_path", "_rule", F.coalesce("_ruled", judged).alias("_verdict"), "_score")
    return out.toDF(*pages.columns, *names.values())
