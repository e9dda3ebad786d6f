"""Named output formats: a registry of functions from (Column, its type) to (Column, its type)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import normalize

Format = Callable[[Column, T.DataType], tuple[Column, T.DataType]]


def title_case(c: Column) -> Column:
    """A capital after anything that is not a letter, small letters elsewhere; initcap knows blanks only."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))), "")


def _text(function: Callable[[Column], Column]) -> Format:
    def apply(c: Column, kind: T.DataType):
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            raise ValueError(f"a text format needs a scalar, not {kind.simpleString()}")
        return function(c.cast("string")), T.StringType()

    return apply


def _join(separator: str) -> Format:
    def apply(c: Column, kind: T.DataType):
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType)):
                raise ValueError(f"a join needs scalars, not {kind.simpleString()}")
            return F.array_join(F.transform(c, lambda x: x.cast("string")), separator), T.StringType()
        return _text(lambda x: x)(c, kind)

    return apply


def _first(c: Column, kind: T.DataType):
    return (F.get(c, F.lit(0)), kind.elementType) if isinstance(kind, T.ArrayType) else (c, kind)


def _count(c: Column, kind: T.DataType):
    some = F.size(c).cast("long") if isinstance(kind, T.ArrayType) else F.lit(1).cast("long")
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(some), T.LongType()


FORMATS: dict[str, Format] = {
    "uppercase": _text(F.upper),
    "lowercase": _text(F.lower),
    "titlecase": _text(title_case),
    "strip": _text(normalize.strip),
    "e164": _text(normalize.phone),
    "yyyy-mm": _text(normalize.date),
    "iso-alpha2": _text(normalize.country),
    "join_comma": _join(", "),
    "join_newline": _join("\n"),
    "first": _first,
    "count": _count,
}
