"""Quality rules with host verdicts.

Every document is measured against a few rules; failures are counted per host,
the host's failure rate is shrunk with a beta prior fitted to all hosts, and the
verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, map_batches, saved

# ---- fixed values of the rules ----------------------------------------------
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINE_PERCENT = 30
WORD_CHARS = (2, 15)
#: A host fails if its shrunk failure rate is over this, and so many times the mean of all hosts.
MAX_HOST_RATE = 0.5
MAX_HOST_RATIO = 1.5
# -----------------------------------------------------------------------------

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measure(text: bytes) -> tuple[int, ...]:
    """The six measures of one text, in the order of ``MEASURES``."""
    words = text.split()
    seen = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(seen) < len(words) - 2:  # else no window occurs twice
        until = 0
        for at, window in enumerate(zip(words, words[1:], words[2:])):
            if seen[window] > 1:
                repeated += at + 3 - max(until, at)
                until = at + 3
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    solid = text.translate(None, SPACES)
    return (
        len(words),
        len(solid.translate(None, CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(doc_id, host)`` and the measures of every row; a null text is empty."""
    names = ["doc_id", "host", *(field.split()[0] for field in MEASURES.split(", "))]

    def run(batches):
        for batch in batches:
            columns = list(zip(*map(measure, batch_bytes(batch, "text")))) or [()] * 6
            arrays = [batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[host_col].cast("string").alias("host"), docs[text_col].cast("string").alias("text")
    )
    return map_batches(rows, f"doc_id long, host string, {MEASURES}", run)


def host_verdicts(failures: DataFrame) -> DataFrame:
    """``(host, n_docs, n_failed, host_rate, host_ok)`` from ``(host, failed boolean)`` rows.

    The prior's mean is the failure rate over all documents, its strength comes
    from the spread between hosts beyond that of sampling. Hosts with few
    documents lean on the prior.
    """
    hosts = saved(
        failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts"
    )
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    # Moments: one row of sums over all hosts.
    sums = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(f), F.sum(f * f / n)).first()
    count, docs, failed, squares = (float(x or 0) for x in sums)
    mean = failed / docs if docs else 0.0
    between = (squares - docs * mean * mean - mean * (1 - mean) * count) / docs if docs else 0.0
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    rate = (f + mean * strength) / (n + strength)
    limit = max(MAX_HOST_RATE, MAX_HOST_RATIO * mean)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("host_rate"), (rate <= limit).alias("host_ok"))


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: measures, ``failed_rules``, base_failed, the host's rate and ``kept``.

    ``kept``: the document breaks no rule itself and its host is not rejected.
    Null texts have no words and fail; a null host is a host of its own; repeated
    rows count each; an empty table gives an empty one. The join is one row per
    host against documents, whose side Spark may split at a hot host.
    """
    rows = saved(measures(docs, id_col, text_col, host_col), "measures")
    words = F.col("n_words")
    short = words < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words
    broken = {
        "short": short,
        "repeats": repeats,
        "symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * words,
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
        "word_length": (F.col("word_chars") < WORD_CHARS[0] * words) | (F.col("word_chars") > WORD_CHARS[1] * words),
    }
    failed_rules = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in broken.items()]))
    rows = rows.withColumn("base_failed", short | repeats).withColumn("failed_rules", failed_rules)
    rows = rows.withColumn("failed", F.size("failed_rules") > 0)
    verdicts = host_verdicts(rows.select("host", "failed")).withColumnRenamed("host", "of")
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("of")))
    return joined.withColumn("kept", ~F.col("failed") & F.col("host_ok")).drop("of", "failed", "n_docs", "n_failed")


SQL = r"""
WITH texts AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM texts)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT t.doc_id, t.host, len(w.w)::BIGINT AS n_words,
    length(regexp_replace(t.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM texts t JOIN words w USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.5 * n_words
      OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed
  FROM measured
), hosts AS (
  SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM judged GROUP BY host
), moments AS (
  SELECT sum(f) / sum(n) AS m, (sum(f * f / n) - sum(f) * sum(f) / sum(n) - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * count(*)) / sum(n) AS b
  FROM hosts
), prior AS (
  SELECT m, CASE WHEN b > 0 THEN least(greatest(m * (1 - m) / b - 1, 1), 1e6) ELSE 1e6 END AS s FROM moments
), verdicts AS (
  SELECT host, (f + m * s) / (n + s) <= greatest(0.5, 1.5 * m) AS host_ok FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND host_ok AS kept
FROM judged JOIN verdicts ON judged.host IS NOT DISTINCT FROM verdicts.host
"""
