"""Text expressions: names, lists in text columns, case-insensitive comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def same(a: Column, b: Column) -> Column:
    """Equality as a case-insensitive collation has it."""
    return F.lower(a) == F.lower(b)


def holds(a: Column, term: str) -> Column:
    """Whether a holds the term, whatever its case."""
    return F.lower(a).contains(term.lower())


def begins(a: Column, term: str) -> Column:
    return F.lower(a).startswith(term.lower())


def joined(*parts: Column) -> Column:
    """Parts put together with a blank between; a null counts as empty, unlike in Spark's own concat."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def or_default(a: Column, default: str) -> Column:
    """The default where a is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), F.lit(default))


def norm_name(a: Column) -> Column:
    """A name without blanks, hyphens and case, for matching spellings."""
    return F.lower(F.regexp_replace(F.trim(a), "[- ]", ""))


def items(a: Column, mark: str = "~") -> Column:
    """A delimited list as an array: trimmed, without blank items."""
    return F.filter(F.transform(F.split(a, "\\Q" + mark + "\\E"), lambda x: F.trim(x)), lambda x: x != "")


def without_html(a: Column) -> Column:
    """Text of a page: tags become blanks, white space becomes one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]*>", " "), r"[\x20\x09-\x0D]+", " "))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts with a bar between; a null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def pseudonym(a: Column, prefix: str) -> Column:
    """A stable stand-in for an identifier: the same id gives the same name in every run."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(a.cast("string"), 256), 1, 10))


def salary(a: Column) -> Column:
    """Least and most, currency and period of a salary given as text; null parts where it says nothing."""
    numbers = F.transform(
        F.regexp_extract_all(F.regexp_replace(a, ",", ""), F.lit(r"(\d+(?:\.\d+)?)\s*([kK]?)"), 0),
        lambda x: F.regexp_extract(x, r"[\d.]+", 0).cast("double") * F.when(F.lower(x).endswith("k"), 1000).otherwise(1),
    )
    low = F.lower(a)
    return F.struct(
        F.array_min(numbers).alias("least"),
        F.array_max(numbers).alias("most"),
        F.when(low.rlike(r"\$|usd"), "USD").when(low.rlike("€|eur"), "EUR").when(low.rlike("£|gbp"), "GBP").alias("currency"),
        F.when(low.rlike("hour|/ ?hr"), "hour").when(low.rlike("month|/ ?mo"), "month").when(low.rlike("year|annum|/ ?yr"), "year").alias("period"),
    )


def country_code(a: Column) -> Column:
    """The calling code of a number written with a plus: what stands before the first blank, hyphen or bracket; null for others."""
    return F.nullif(F.regexp_extract(F.trim(a), r"^\+(\d{1,3})(?=[\s(\-.])", 1), F.lit(""))


def e164(a: Column, home: str = "1") -> Column:
    """A phone number with a plus and digits only, of the home country if it names none; null if it has too few or too many."""
    digits = F.regexp_replace(a, r"\D", "")
    whole = F.when(F.trim(a).startswith("+"), digits).otherwise(F.concat(F.lit(home), F.ltrim(digits, F.lit("0"))))
    return F.when(F.length(whole).between(8, 15), F.concat(F.lit("+"), whole))


def member(a: Column, names: tuple[str, ...]) -> Column:
    """The value if it is one of the names, else null."""
    return F.when(a.isin(*names), a)


def digits_or_zero(a: Column) -> Column:
    """The number that an id of digits is, 0 for any other id: for sorting."""
    return F.when(a.rlike("^[0-9]{1,18}$"), a.cast("long")).otherwise(F.lit(0).cast("long"))


def stable_id(*parts: Column) -> Column:
    """An id in the form of a UUID that follows from the parts, so that reruns give the same."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def id_seed(a: Column) -> Column:
    """The number that the first eight hexadecimal digits of an id are."""
    return F.conv(F.substring(F.regexp_replace(a, "-", ""), 1, 8), 16, 10).cast("long")
