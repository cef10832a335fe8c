"""Format-preserving pseudonyms for personal numbers and dates, in column expressions.

Values are found by one pattern, validated by kind, and replaced through keyed
Feistel networks on their own format: a card number becomes a card number with
a right check digit, a date a date, an address an address. Equal values get
equal pseudonyms in all documents; within a kind different values stay
different. Nothing is looked up, so no table of values is built or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# ---- fixed values: what is looked for ----------------------------------------
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])"
DATE = r"(?<![\w/.-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?!\w|[-/.][0-9])"
CARD = (
    r"(?<!\w)(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}"
    r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?!\w|-[0-9])"
)
PHONE = r"(?<!\w)(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w|-[0-9])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w|-[0-9])"
SECRET = r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)"
# ------------------------------------------------------------------------------

PATTERN = "|".join((EMAIL, IPV4, DATE, CARD, PHONE, SSN, SECRET))
ROUNDS = 10
KEY = "change this key"
#: 1900-01-01 to 2099-12-31 are 73,049 = 319 * 229 days.
DAYS = (319, 229)
FIRST_DAY = "1900-01-01"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _number(digest: Column, start, length: int) -> Column:
    return F.conv(F.substr(digest, F.lit(start) if isinstance(start, int) else start, F.lit(length)), 16, 10).cast("long")


def feistel_pair(a: Column, b: Column, size_a: int, size_b: int, key: str) -> Column:
    """Keyed permutation of the pairs (a < size_a, b < size_b), as a struct; the halves change in turn."""

    def step(s, r):
        even = r % 2 == 0
        digest = F.sha2(F.concat_ws(":", F.lit(key), r, F.when(even, s["b"]).otherwise(s["a"])), 256)
        more = _number(digest, 1, 12)
        return F.struct(
            F.when(even, F.pmod(s["a"] + more, F.lit(size_a).cast("long"))).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + more, F.lit(size_b).cast("long"))).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _shifted(c: Column, by: Column, hexadecimal: bool) -> Column:
    code = F.ascii(c)
    if hexadecimal:
        lower = F.instr(F.lit("0123456789abcdef"), c)
        at = F.when(lower > 0, lower).otherwise(F.instr(F.lit("0123456789ABCDEF"), c)) - 1
        moved = F.pmod(at + by, F.lit(16)).cast("int") + 1
        return F.substr(F.lit("0123456789abcdef"), moved, F.lit(1))
    kinds = [(48, 10), (65, 26), (97, 26)]
    out = c
    for first, n in kinds:
        moved = F.chr(F.pmod(code - first + by, F.lit(n)) + first)
        out = F.when((code >= first) & (code < first + n), moved).otherwise(out)
    return out


def feistel_text(text: Column, key: str, hexadecimal: bool = False) -> Column:
    """Keyed permutation of the texts of one form: digits stay digits, letters letters, the rest stays.

    One half's characters are moved within their kind by a digest of the other
    half, then the halves change places; the number of rounds is even.
    """

    def step(s, r):
        digest = F.sha2(F.concat_ws(":", F.lit(key), r, s["b"]), 512)
        moved = _let(
            digest,
            lambda d: F.array_join(
                F.transform(F.split(s["a"], ""), lambda c, i: _shifted(c, _number(d, F.pmod(i, F.lit(32)) * 4 + 1, 4), hexadecimal)), ""
            ),
        )
        return F.struct(s["b"].alias("a"), F.when(F.length(s["a"]) > 0, moved).otherwise(s["a"]).alias("b"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text)).alias("b"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda s: F.concat(s["a"], s["b"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, one after the other, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s, c):
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(digit, s["at"] + 1).otherwise(s["at"]).alias("at"),
        )

    return F.aggregate(F.split(form, ""), start, step)["out"]


def check_digit(payload: Column) -> Column:
    """The Luhn digit that completes ``payload``."""

    def worth(c, i):
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), worth), F.lit(0), lambda s, x: s + x)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _card(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    valid = check_digit(payload) == F.substr(digits, F.length(digits), F.lit(1))
    middle = feistel_text(F.substr(payload, F.lit(2), F.length(payload)), key)
    whole = _let(F.concat(F.substr(payload, F.lit(1), F.lit(1)), middle), lambda p: F.concat(p, check_digit(p)))
    return valid, _let(whole, lambda d: _refilled(value, d))


def _ip(value: Column, key: str) -> tuple[Column, Column]:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    plain = F.array_join(F.transform(octets, lambda x: x.cast("string")), ".") == value
    valid = plain & (F.array_max(octets) < 256)
    moved = _let(octets, lambda o: feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key))
    parts = lambda s: [F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256]
    return valid, _let(moved, lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for x in parts(s)]))


def _date(value: Column, key: str) -> tuple[Column, Column]:
    mark = F.regexp_extract(value, "[-/.]", 0)
    parts = F.transform(F.split(value, "[-/.]"), lambda x: x.cast("int"))
    year_first = value.rlike("^[0-9]{4}")
    same_mark = value.rlike(r"^[0-9]+-[0-9]+-|^[0-9]+/[0-9]+/|^[0-9]+\.[0-9]+\.")

    def made(y, m, d):
        text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        day = F.try_to_date(text, "yyyy-MM-dd")
        return F.when(day.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), day)

    day_first_date = made(parts[2], parts[1], parts[0])
    month_first = day_first_date.isNull() & ~year_first
    date = F.when(year_first, made(parts[0], parts[1], parts[2])).otherwise(F.coalesce(day_first_date, made(parts[2], parts[0], parts[1])))
    at = F.date_diff(date, F.lit(FIRST_DAY).cast("date"))
    moved = _let(at, lambda n: feistel_pair(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, key))
    day = _let(moved, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int")))
    padded = value.rlike("^(?:[0-9]{4}.[0-9]{2}.[0-9]{2}|[0-9]{2}.[0-9]{2}.[0-9]{4})$")

    def written(d):
        y = F.year(d).cast("string")
        m, n = (F.when(padded, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string")) for x in (F.month(d), F.dayofmonth(d)))
        return (
            F.when(year_first, F.concat_ws("-", y, m, n)).when(month_first, F.concat_ws("-", m, n, y)).otherwise(F.concat_ws("-", n, m, y))
        )

    return same_mark & date.isNotNull(), F.replace(_let(day, written), F.lit("-"), mark)


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value; null if it is not valid for any kind."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    card_valid, card = _card(value, f"{key}:card")
    ip_valid, ip = _ip(value, f"{key}:ip")
    date_valid, date = _date(value, f"{key}:date")
    ending = F.regexp_extract(value, r"\.[A-Za-z]{2,}$", 0)
    name = F.substr(value, F.lit(1), F.length(value) - F.length(ending))
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(value, F.length(country) + 1, F.length(value))
    secret = feistel_text(value, f"{key}:secret", hexadecimal=True)
    return (
        F.when(value.contains("@"), F.concat(feistel_text(name, f"{key}:email"), ending))
        .when(whole(IPV4), F.when(ip_valid, ip))
        .when(whole(DATE), F.when(date_valid, date))
        .when(whole(CARD), F.when(card_valid, card))
        .when(whole(PHONE), F.concat(country, feistel_text(rest, f"{key}:phone")))
        .when(whole(SSN), feistel_text(value, f"{key}:ssn"))
        .when(whole(SECRET), F.when(value == F.upper(value), F.upper(secret)).otherwise(secret))
    )


def pseudonymised(docs: DataFrame, key: str = KEY, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All columns of ``docs``, the text with every valid value replaced; with ``count_col`` also their number.

    Null stays null (count 0), texts without values stay as they are, whatever
    their length; repeated rows stay. Candidates that fail validation, such as a
    number with a wrong check digit or 2024-02-30, are left alone.
    """
    found, made = fresh(docs, "_pii_found"), fresh(docs, "_pii_made")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.withColumn(found, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn(made, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    filled = F.zip_with(made, found, lambda new, old: F.coalesce(new, old))
    pieces = F.zip_with(F.split(text, PATTERN, -1), F.concat(filled, F.array(F.lit(""))), lambda p, m: F.concat(p, m))
    number = F.coalesce(F.size(F.filter(made, lambda x: x.isNotNull())), F.lit(0))
    rows = rows.withColumn(text_col, F.when(F.col(made).isNotNull(), F.array_join(pieces, "")).otherwise(text))
    if count_col:
        rows = rows.withColumn(count_col, F.when(F.col(made).isNotNull(), number).otherwise(0))
    return rows.drop(found, made)


def pii(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_pii, text)`` for every row of ``docs``."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return pseudonymised(rows, key, count_col="n_pii").select("doc_id", F.col("n_pii").cast("int").alias("n_pii"), "text")
