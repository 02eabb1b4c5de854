"""Keys and codes written in several ways, brought to one form. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def firm_key(c: Column) -> Column:
    """A registrant number without prefix, padding and trailing ``.0``; null where no digit is left.

    "CIK0001000437", " 1000437.0 " and "1000437" give "1000437"; zeros alone give "0".
    """
    text = c.cast("string")
    # Digits alone, the usual case, need one pattern instead of three.
    plain = F.coalesce(F.nullif(F.ltrim(text, F.lit("0")), F.lit("")), F.lit("0"))
    digits = F.regexp_replace(F.regexp_replace(text, r"\.0+(?=[^0-9]*$)", ""), "[^0-9]", "")
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(text.rlike("^[0-9]+$"), plain).otherwise(F.nullif(bare, F.lit("")))


def accession_key(c: Column) -> Column:
    """An accession number as 0000000000-00-000000; null unless 1 to 18 digits are found in the last path component."""
    text = c.cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, "^.*/", ""), "[^0-9]", "")
    full = F.lpad(digits, 18, "0")
    shaped = F.concat_ws("-", full.substr(1, 10), full.substr(11, 2), full.substr(13, 6))
    # A number in the right form, the usual case, needs one pattern instead of two.
    return F.when(text.rlike("^[0-9]{10}-[0-9]{2}-[0-9]{6}$"), text).when(F.length(digits).between(1, 18), shaped)


def annual_form(c: Column) -> Column:
    """10-K or 10-K/A for any spelling of these (case, spaces, kinds of hyphen, the word form), else null."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "^FORM", "")
    return F.when(c.isin("10-K", "10-K/A"), c).when(bare == "10K", "10-K").when(bare == "10KA", "10-K/A")
