"""Scalar functions as column expressions. A null input gives null unless a docstring says otherwise."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is positive, else null."""
    return F.when(denominator > 0, numerator / denominator)


def plain_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null for a zero denominator."""
    return F.try_divide(numerator, denominator)


def safe_log(x: Column) -> Column:
    """Natural logarithm of a positive number, else null."""
    return F.when(x > 0, F.ln(x))


def null_sum(a: Column, b: Column) -> Column:
    """Sum with a null side as 0; null where both are."""
    zero = F.lit(0.0)
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, zero) + F.coalesce(b, zero))


def clip(x: Column, low: Column, high: Column) -> Column:
    """x moved into [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def is_in(c: Column, values: Iterable) -> Column:
    """Membership that is false for null."""
    return F.coalesce(c.isin(*values), F.lit(False))


def all_known(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def any_known(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns))


def null_count(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in columns))


def numeric_key(c: Column) -> Column:
    """A registrant number by way of a number: null for text that isn't one."""
    number = c.cast("string").try_cast("double")
    return F.when(number.isNotNull() & (F.abs(number) < 1e15), number.cast("long").cast("string"))


def to_int(c: Column) -> Column:
    """Whole number in text form, also with decimals ("1750.0"); null otherwise."""
    number = c.cast("string").try_cast("double")
    return F.when(number.between(-2147483648.0, 2147483647.0), number.cast("int"))


def parse_year(c: Column) -> Column:
    """The four digits at the start of a text, after white space."""
    return F.nullif(F.regexp_extract(c, r"(?U)^\s*([0-9]{4})", 1), F.lit("")).cast("int")


def squish(c: Column) -> Column:
    """White space runs become one blank, those at the ends go."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def structured_text(c: Column) -> Column:
    """Text by lines: bullets, table bars and list items begin lines, blanks are collapsed, at most one line is empty."""
    x = F.regexp_replace(c, r"\r\n?", "\n")
    x = F.regexp_replace(x, "[•‣◦⁃∙▪●]", "\n")
    x = F.regexp_replace(x, r"(?U)\s+\|\s+", "\n")
    x = F.regexp_replace(x, r"(?U)\s+(?=(?:[0-9]{1,2}|[A-Za-z])\)\s+[A-Z])", "\n")
    x = F.regexp_replace(x, r"(?U)[^\S\n]+", " ")
    x = F.regexp_replace(x, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def parse_percent(c: Column) -> Column:
    """"12.3%" or "12.3" as 0.123; null for suppressed values (S, N, a full stop) and anything else."""
    bare = F.trim(F.regexp_replace(c, "%", ""))
    return F.when(bare.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), bare.cast("double") / 100)


def parse_date(c: Column) -> Column:
    """A date written 2020-01-31 or 01/31/2020, else null."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy"))


def truth(c: Column) -> Column:
    """True for true, 1 and yes in any case, else false, null included."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def hash_fraction(c: Column) -> Column:
    """A fixed number in [0, 1) from the first 64 bits of the text's SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def stars(p: Column, steps: tuple[tuple[float, str], ...] = ((0.01, "***"), (0.05, "**"), (0.1, "*"))) -> Column:
    """Significance marks: of ascending steps the first that p is below; empty otherwise and for null."""
    out = F.lit("")
    for limit, mark in reversed(steps):
        out = F.when(p < limit, mark).otherwise(out)
    return out


FINE_STEPS = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."))


def fixed(x: Column, digits: int = 3) -> Column:
    """A number with a fixed number of decimals, never a negative zero; empty for null."""
    text = F.format_string(f"%.{digits}f", x)
    zero = f"{0:.{digits}f}"
    return F.when(x.isNull(), "").when(text == f"-{zero}", zero).otherwise(text)


def grouped(x: Column) -> Column:
    """A whole number with thousands separators; empty for null."""
    return F.coalesce(F.format_number(x, 0), F.lit(""))


@F.pandas_udf(T.DoubleType())
def _two_sided(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for z in batches:
        yield z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def normal_p(estimate: Column, error: Column) -> Column:
    """Two-sided normal p-value; null for a null or non-positive standard error."""
    return _two_sided(F.when(error > 0, estimate / error))


def interval(estimate: Column, error: Column, z: float = 1.96) -> tuple[Column, Column]:
    return estimate - z * error, estimate + z * error


def sector_code(c: Column) -> Column:
    """Two-digit industry codes that belong together are joined: 31-33, 44-45, 48-49."""
    code = F.trim(c)
    return F.when(code.isin("31", "32", "33"), "31-33").when(code.isin("44", "45"), "44-45").when(code.isin("48", "49"), "48-49").otherwise(code)


def code_prefix(c: Column, length: int) -> Column:
    """The first digits of a code that has at least as many."""
    text = c.cast("string")
    return F.when(F.length(text) >= length, F.substring(text, 1, length))


def safe_extension(name: Column) -> Column:
    """Extension of a document's name if it is one of the known ones, else htm."""
    found = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(found.isin("htm", "html", "txt", "xml", "xhtml"), found).otherwise("htm")


def filing_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    """Address of a filing's main document, or of its complete submission where there is none."""
    folder = F.concat_ws("/", F.lit(base.rstrip("/")), cik, F.regexp_replace(accession, "-", ""))
    return F.when(F.coalesce(F.trim(document), F.lit("")) != "", F.concat_ws("/", folder, F.trim(document))).otherwise(F.concat(folder, F.lit("/"), accession, F.lit(".txt")))


def payload_ok(payload: Column, markers: Iterable[str], least_bytes: int = 200, head: int = 131072) -> Column:
    """A download's check: long enough, and none of the markers of an error page in its beginning."""
    start = F.lower(F.substring(payload, 1, head))
    good = F.octet_length(payload) >= least_bytes
    for marker in markers:
        good = good & ~F.contains(start, F.lit(marker.lower()))
    return F.coalesce(good, F.lit(False))
