"""Declared schemas: what sources give, what a merge gives, and what a text extractor has to give."""

from __future__ import annotations

from pyspark.sql import types as T

_LOCATION = "struct<city:string, region:string, country:string>"
_LINKS = "struct<linkedin:string, github:string, portfolio:string, other:array<string>>"
_EXPERIENCE = "array<struct<company:string, title:string, start:string, end:string, summary:string>>"
_EDUCATION = "array<struct<institution:string, degree:string, field_of_study:string, start:string, end:string>>"

#: One record of one source, before linkage. ``ordinal`` orders records: linkage and every tie follow it.
RAW_PROFILE = f"""ordinal bigint, full_name string, emails array<string>, phones array<string>, location {_LOCATION},
links {_LINKS}, skills array<string>, experience {_EXPERIENCE}, education {_EDUCATION}, _source_id string, _source_type string"""

#: One entity after the merge.
CANONICAL = f"""candidate_id string, full_name string, emails array<string>, phones array<string>, location {_LOCATION},
links {_LINKS}, skills array<struct<name:string, confidence:double, sources:array<string>>>, experience {_EXPERIENCE},
education {_EDUCATION}, overall_confidence double,
provenance array<struct<field:string, source:string, method:string, value:string>>, raw_sources array<string>"""

#: The output of a text extractor.
EXTRACTED = f"""full_name string, emails array<string>, phones array<string>, location {_LOCATION}, links {_LINKS},
skills array<string>, experience {_EXPERIENCE}, education {_EDUCATION}"""


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def type_of(schema: str, field: str) -> str:
    """The DDL type of one field of a declared schema."""
    return struct_of(schema)[field].dataType.simpleString()
