"""Normalisers as Column functions: ``try_*`` gives null for what cannot be normalised, ``strict`` raises.

Everything here is a built-in expression that runs in the JVM, without Python workers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of source types and that of any other.
SOURCE_WEIGHTS = {"ats": 0.95, "recruiter_notes": 0.75}
OTHER_WEIGHT = 0.70

# Bounds of phone digits, years and months.
PHONE_DIGITS = (7, 15)
YEARS, MONTHS_IN_YEAR = (1900, 2100), (1, 12)

# Words for a date that is still open.
PRESENT_WORDS = ("present", "current", "now", "ongoing", "till date", "to date")

# Month names; the first three letters stand for each too, and sept for september.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Names of countries besides their two-letter codes.
COUNTRY_ALIASES = {
    "US": ("usa", "u.s.", "u.s.a.", "united states", "united states of america", "america"),
    "GB": ("uk", "u.k.", "united kingdom", "great britain", "britain", "england", "scotland", "wales"),
    "CA": ("can", "canada"),
    "AU": ("aus", "australia"),
    "DE": ("deu", "germany", "deutschland"),
    "FR": ("fra", "france"),
    "IN": ("ind", "india"),
    "CN": ("chn", "china", "prc", "people's republic of china"),
    "JP": ("jpn", "japan"),
    "BR": ("bra", "brazil", "brasil"),
    "MX": ("mex", "mexico", "méxico"),
    "NL": ("nld", "netherlands", "the netherlands", "holland"),
    "ES": ("esp", "spain", "españa"),
    "IT": ("ita", "italy", "italia"),
    "SE": ("swe", "sweden", "sverige"),
    "NO": ("nor", "norway", "norge"),
    "DK": ("dnk", "denmark", "danmark"),
    "FI": ("fin", "finland", "suomi"),
    "CH": ("che", "switzerland", "schweiz"),
    "PL": ("pol", "poland", "polska"),
    "PT": ("prt", "portugal"),
    "KR": ("kor", "south korea", "korea", "republic of korea"),
    "SG": ("sgp", "singapore"),
    "NZ": ("nzl", "new zealand"),
    "ZA": ("zaf", "south africa"),
    "NG": ("nga", "nigeria"),
    "KE": ("ken", "kenya"),
    "IL": ("isr", "israel"),
    "AE": ("are", "uae", "united arab emirates", "emirates"),
    "RU": ("rus", "russia", "russian federation"),
    "UA": ("ukr", "ukraine"),
    "AR": ("arg", "argentina"),
    "CL": ("chl", "chile"),
    "CO": ("col", "colombia"),
    "PK": ("pak", "pakistan"),
    "BD": ("bgd", "bangladesh"),
    "ID": ("idn", "indonesia"),
    "PH": ("phl", "philippines"),
    "VN": ("vnm", "vietnam", "viet nam"),
    "TH": ("tha", "thailand"),
    "MY": ("mys", "malaysia"),
    "EG": ("egy", "egypt"),
    "TR": ("tur", "turkey", "türkiye"),
    "RO": ("rou", "romania", "românia"),
    "CZ": ("cze", "czech republic", "czechia", "czech"),
    "HU": ("hun", "hungary"),
    "GR": ("grc", "greece", "hellas"),
    "AT": ("aut", "austria", "österreich"),
    "BE": ("bel", "belgium", "belgique"),
    "IE": ("irl", "ireland", "eire"),
    "HK": ("hkg", "hong kong"),
    "TW": ("twn", "taiwan"),
}


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def strip(c: Column) -> Column:
    """Without white space at either end; Spark's trim strips spaces only."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def safe_str(c: Column, fallback: str | None = None) -> Column:
    """Stripped string form; null and blank become the fallback."""
    s = strip(c.cast("string"))
    return F.when(s != "", s).otherwise(F.lit(fallback))


def clean_list(c: Column) -> Column:
    """Stripped items without the blank ones; a null array is empty."""
    return F.filter(F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), strip), lambda x: x != "")


def first_truthy(*cs: Column) -> Column:
    """The leftmost string that is neither null nor empty, NOT stripped: blanks win and become null only afterwards."""
    return F.coalesce(*[F.when(c != "", c) for c in cs])


def email_key(c: Column) -> Column:
    """Lower-cased and stripped."""
    return F.lower(strip(c))


def try_phone(c: Column) -> Column:
    """E.164 form: 7 to 15 digits, with a leading plus, or ten of them (+1 is added), or eleven from 1."""
    s = strip(c)
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when((n < PHONE_DIGITS[0]) | (n > PHONE_DIGITS[1]), None)
        .when(F.startswith(s, F.lit("+")), F.concat(F.lit("+"), digits))
        .when(n == 10, F.concat(F.lit("+1"), digits))
        .when((n == 11) & F.startswith(digits, F.lit("1")), F.concat(F.lit("+"), digits))
    )


def phone_reject_reason(c: Column) -> Column:
    """Why ``try_phone`` gives null; null where it does not."""
    n = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return (
        F.when(c.isNull() | (strip(c) == ""), "blank")
        .when(n == 0, "no digits")
        .when(n > PHONE_DIGITS[1], "too many digits")
        .when(n < PHONE_DIGITS[0], "too few digits")
        .when(try_phone(c).isNull(), "no country code")
    )


def _month_number(name: Column) -> Column:
    pairs = [(form, i) for i, m in enumerate(MONTHS, 1) for form in dict.fromkeys((m, m[:3]))] + [("sept", 9)]
    return F.try_element_at(_literal_map(pairs), F.lower(name))


def try_date(c: Column) -> Column:
    """``YYYY-MM``, or ``Present`` for an open end; the day, if any, is not looked at."""
    s = strip(c)
    group = lambda pattern, i: F.regexp_extract(s, pattern, i)
    numeric, name_first, year_first, year_only = r"^([0-9]{4})[/\-.]([0-9]{1,2})(?:[/\-.]([0-9]{1,2}))?$", r"^([A-Za-z]+)\.?(?U:\s)+([0-9]{4})$", r"^([0-9]{4})(?U:\s)+([A-Za-z]+)\.?$", r"^([0-9]{4})$"

    def written(year, month):
        y = year.cast("int")
        ok = y.between(*YEARS) & month.between(*MONTHS_IN_YEAR)
        return F.when(ok, F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))

    return (
        F.when(F.lower(s).isin(*PRESENT_WORDS), F.lit("Present"))
        .when(s.rlike(numeric), written(group(numeric, 1), group(numeric, 2).cast("int")))
        .when(s.rlike(name_first), written(group(name_first, 2), _month_number(group(name_first, 1))))
        .when(s.rlike(year_first), written(group(year_first, 1), _month_number(group(year_first, 2))))
        .when(s.rlike(year_only), written(s, F.lit(1)))
    )


def try_country(c: Column) -> Column:
    """Two-letter code of a known name, or any two letters as they are, upper-cased."""
    s = strip(c)
    names = _literal_map([(alias, code) for code, aliases in COUNTRY_ALIASES.items() for alias in aliases])
    upper = F.upper(s)
    return F.coalesce(F.try_element_at(names, F.lower(s)), F.when(upper.rlike("^[A-Z]{2}$"), upper))


def source_weight(source_type: Column, weights: dict[str, float] | None = None, other: float = OTHER_WEIGHT) -> Column:
    """How far a source type is trusted."""
    weights = SOURCE_WEIGHTS if weights is None else weights
    return reduce(lambda acc, kv: acc.when(source_type == kv[0], F.lit(kv[1])), weights.items(), F.when(source_type.isNull(), F.lit(other))).otherwise(F.lit(other))


def strict(normaliser, name: str):
    """The raising form of a ``try_*`` function: null stays null, anything else that cannot be normalised is an error."""

    def apply(c: Column) -> Column:
        # raise_error must be typed like the value for the branches to agree.
        fail = F.raise_error(F.concat(F.lit(f"{name}: cannot normalise '"), c.cast("string"), F.lit("'"))).cast("string")
        return F.when(c.isNull(), None).otherwise(F.coalesce(normaliser(c.cast("string")), fail))

    return apply


phone, date, country = strict(try_phone, "e164"), strict(try_date, "yyyy-mm"), strict(try_country, "iso-alpha2")
