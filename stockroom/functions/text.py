"""Column functions for the cross-cutting value rules: blanks, money, numbers, addresses, markup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"(?U)^\s+|\s+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Text without white space of any kind around it; null as blank."""
    return F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), SPACE, "")


def key(c: Column | str) -> Column:
    """What titles are compared by: stripped, in lower case."""
    return F.lower(stripped(c))


def filled(c: Column | str) -> Column:
    """Whether a value is there and not blank."""
    return stripped(c) != ""


def money(c: Column | str) -> Column:
    """A price as a decimal; 0 where it is missing or no number (``1_000`` and ``NaN`` are none)."""
    return F.coalesce(col(c).try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))


def positive(c: Column | str) -> Column:
    """A price above 0, else null."""
    return F.when(money(c) > 0, money(c))


def first_filled(*columns: Column | str) -> Column:
    """The first value that isn't null or empty."""
    return F.coalesce(*[F.when(col(c) != "", col(c)) for c in columns])


def without_markup(c: Column | str) -> Column:
    """HTML as text: scripts and styles go with their content, then all tags; entities stay; null as blank."""
    text = F.coalesce(col(c), F.lit(""))
    for element in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{element}[^>]*>.*?</{element}>", "")
    return stripped(F.regexp_replace(text, r"<[^>]+>", ""))


def gtin(c: Column | str) -> Column:
    """A plausible article number: blanks and hyphens dropped, 8, 13 or 14 digits, 12 made 13, not all zeros; else null."""
    digits = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), "[- ]", "")
    digits = F.when(F.length(digits) == 12, F.lpad(digits, 13, "0")).otherwise(digits)
    return F.when(digits.rlike("^[0-9]+$") & ~digits.rlike("^0+$") & F.length(digits).isin(8, 13, 14), digits)


def url_path(c: Column | str) -> Column:
    """The path of an address without the parameters of its last segment; never null, never fails."""
    url = F.coalesce(col(c), F.lit(""))
    path = F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)).otherwise(F.regexp_extract(url, "^(?://[^/?#]*)?([^?#]*)", 1))
    return F.regexp_replace(path, ";[^/]*$", "")


def domain(c: Column | str) -> Column:
    """Host with port and user of an address, ``https://`` being assumed where no scheme is given."""
    url = F.coalesce(col(c), F.lit(""))
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_extract(full, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def price_string(c: Column | str) -> Column:
    """A feed's price text as struct<amount string, currency string>: a last word of three letters is the currency; else the first word is the amount; a comma beside a point goes, alone it is the point."""
    words = F.split(stripped(c), r"\s+")
    last = F.element_at(words, -1)
    has = (F.size(words) > 1) & last.rlike("^[A-Za-z]{3}$")
    amount = F.when(has, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(F.element_at(words, 1))
    amount = F.when(amount.contains(",") & amount.contains("."), F.replace(amount, F.lit(","), F.lit(""))).otherwise(F.replace(amount, F.lit(","), F.lit(".")))
    return F.struct(amount.alias("amount"), F.when(has, F.upper(last)).otherwise("").alias("currency"))


def joined(c: Column | str) -> Column:
    """A list as text with ``; ``; null as blank."""
    return F.coalesce(F.array_join(col(c), "; "), F.lit(""))
