"""Text analysis as column expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
# The 33 English stop words of the standard analyzer.
ENGLISH_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()

# Letters and digits only.
SIMPLE_PATTERN = r"[\p{L}\p{N}]+"

# Unicode word breaking (UAX #29), restricted to the classes that yield tokens.
# Letters and digits of scripts written with spaces, marks and format
# characters sticking to them, underscore joining them; a single mark between
# two letters or two digits joins as well; Han and Hiragana stand alone,
# Katakana runs stay together. A run is cut after 255 characters.
_START = r"[\p{L}\p{Nd}\p{Nl}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]"
_REST = r"[\p{L}\p{Nd}\p{Nl}\p{M}\p{Cf}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\x{200B}]]"
_BETWEEN_LETTERS = r"['‘’․.:·‧]"
_BETWEEN_DIGITS = r"['‘’․.,;]"
_EXTEND = r"[\p{M}\p{Cf}]*"
STANDARD_PATTERN = (
    rf"_*{_START}{_REST}{{0,254}}"
    rf"(?:(?:(?<=\p{{L}}){_BETWEEN_LETTERS}(?=\p{{L}})"
    rf"|(?<=\p{{Nd}}){_BETWEEN_DIGITS}(?=\p{{Nd}})){_START}{_REST}{{0,254}})*"
    rf"|[\p{{IsKatakana}}ー]{{1,255}}"
    rf"|[\p{{IsHan}}\p{{IsHiragana}}]{_EXTEND}"
)
# -------------------------------------------------------------------------

ANALYZERS = {"simple": SIMPLE_PATTERN, "standard": STANDARD_PATTERN}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it inside ``body``.

    Higher-order functions evaluate captured expressions once per element, so
    an expensive array must be bound to a lambda variable first.
    """
    return F.transform(F.array(value), body)[0]


def tokens(text: Column | str, analyzer: str = "standard", stop_words: Iterable[str] = ()) -> Column:
    """Lower-cased tokens of ``text`` in order, as ``array<string>``."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}; expected one of {sorted(ANALYZERS)}")
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ANALYZERS[analyzer]), F.lit(0))
    stop = list(stop_words)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def term_counts(words: Column | str) -> Column:
    """Distinct tokens of one row with their counts: ``array<struct<term,tf>>``.

    Counting inside the row (sort, then run lengths) keeps a document's
    postings where the document is, so building postings needs no shuffle.
    Null for an empty array.
    """
    words = F.col(words) if isinstance(words, str) else words

    def run_lengths(ordered: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (ordered[i] != ordered[i - 1]),
        )
        return _let(
            first,
            lambda at: F.transform(
                at,
                lambda p, j: F.struct(
                    ordered[p].alias("term"),
                    (F.coalesce(F.get(at, j + 1), F.size(ordered)) - p).alias("tf"),
                ),
            ),
        )

    return F.when(F.size(words) > 0, _let(F.sort_array(words), run_lengths))


def strip_tags(text: Column | str, *, prefix: str | None = None, drop: Iterable[str] = ()) -> Column:
    """Cut ``len(prefix)`` leading characters, then remove every ``drop`` string."""
    out = F.col(text) if isinstance(text, str) else text
    if prefix:
        out = F.substring(out, len(prefix) + 1, 2**31 - 1)
    for tag in drop:
        out = F.replace(out, F.lit(tag), F.lit(""))
    return out


def clean_title(line: Column | str) -> Column:
    return strip_tags(line, drop=("<title>", "</title>", "Wikipedia: "))


def clean_url(line: Column | str) -> Column:
    return strip_tags(line, prefix="<url>", drop=("</url>",))


def clean_abstract(line: Column | str) -> Column:
    return strip_tags(line, prefix="<abstract>", drop=("</abstract>",))
