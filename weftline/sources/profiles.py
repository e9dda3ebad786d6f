"""Sources of raw profiles: messy JSON documents, free-text notes, and their ordered union.

JSON is read whole and parsed as a variant, so that keys of any case and values of any type survive to the coalescing
step; a document that cannot be used goes to quarantine with a reason, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.normalize import clean_list, safe_str, strip
from weftline.schemas import EXTRACTED, RAW_PROFILE, struct_of, type_of
from weftline.storage import materialise

# Accepted names of every field of a JSON document, in order of preference.
KEYS = {
    "full_name": ("Full_Name", "full_name", "name"),
    "emails": ("email_PRIMARY", "email_secondary", "email"),
    "phones": ("phone_RAW", "phone", "phone_number"),
    "city": ("city_name", "city"),
    "region": ("state_region", "region", "state"),
    "country": ("cntry", "country", "country_name"),
    "linkedin": ("linkedin_url", "linkedin"),
    "github": ("gh", "github", "github_url"),
    "portfolio": ("portfolio", "portfolio_url"),
    "company": ("employer", "company"),
    "title": ("job_title", "title"),
    "experience_start": ("date_from", "start"),
    "experience_end": ("date_to", "end"),
    "summary": ("responsibilities", "summary"),
    "institution": ("school", "institution"),
    "degree": ("qualification", "degree"),
    "field_of_study": ("subject", "field_of_study"),
    "education_start": ("start_yr", "start"),
    "education_end": ("end_yr", "end"),
    "skills": ("skills_list", "skills"),
}

#: The order of source kinds in a union.
KINDS = ("ats", "recruiter_notes")


# --- variants -------------------------------------------------------------------------------------------------------


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's type; null for an absent value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text_of(kind: Column, s: Column) -> Column:
    return F.when(kind == "BOOLEAN", F.initcap(s)).when(kind == "VOID", None).otherwise(s)


def _truthy_of(kind: Column, s: Column) -> Column:
    return F.coalesce(
        F.when(kind == "VOID", False)
        .when(kind == "STRING", s != "")
        .when(kind == "BOOLEAN", s == "true")
        .when(kind.isin("ARRAY", "OBJECT"), ~s.isin("[]", "{}"))
        .otherwise(F.coalesce(s.try_cast("double") != 0, F.lit(True))),
        F.lit(False),
    )


def _text(v: Column) -> Column:
    """The string form of a value; booleans are capitalised."""
    return _text_of(_kind(v), F.try_variant_get(v, "$", "string"))


def _truthy(v: Column) -> Column:
    return _truthy_of(_kind(v), F.try_variant_get(v, "$", "string"))


def _found(v: Column, keys: tuple[str, ...]) -> Column:
    """The values ``v, kind, s`` that a variant has under some names. Every name is read once, whatever is asked of it."""
    values = F.filter(F.array(*[_get(v, k) for k in keys]), lambda x: x.isNotNull())
    return F.transform(values, lambda x: F.struct(x.alias("v"), _kind(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("s")))


def _chosen(v: Column, keys: tuple[str, ...]) -> Column:
    """The truthy ones among them; the first is the value of a field."""
    return F.filter(_found(v, keys), lambda f: _truthy_of(f["kind"], f["s"]))


def _field(v: Column, name: str, fallback: str | None = None) -> Column:
    text = F.get(F.transform(F.slice(_chosen(v, KEYS[name]), 1, 1), lambda f: safe_str(_text_of(f["kind"], f["s"]))), F.lit(0))
    return text if fallback is None else F.coalesce(text, F.lit(fallback))


def _all(v: Column, name: str) -> Column:
    texts = F.transform(_found(v, KEYS[name]), lambda f: safe_str(_text_of(f["kind"], f["s"])))
    return F.coalesce(F.array_compact(texts), F.array().cast("array<string>"))


def _list(v: Column) -> Column:
    """The array in a variant, empty if there is none."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))


def _strings(v: Column) -> Column:
    """A string is a list of one, list items are turned to strings (null to None), anything else is empty."""
    empty = F.expr("cast(array() as array<string>)")
    one = F.filter(F.array(strip(_text(v))), lambda x: x != "")
    # An explicit null in a JSON array is a variant of type VOID.
    item = lambda x: strip(F.when(x.isNull() | (_kind(x) == "VOID"), F.lit("None")).otherwise(_text(x)))
    return F.when(_kind(v) == "STRING", one).when(_kind(v) == "ARRAY", F.filter(F.transform(_list(v), item), lambda x: x != "")).otherwise(empty)


# --- JSON documents -------------------------------------------------------------------------------------------------


def map_json_documents(docs: DataFrame, source_type: str = "ats") -> tuple[DataFrame, DataFrame]:
    """``(profiles, quarantine)`` of rows ``_source_id, value``; value is the text of one JSON object."""
    v = F.col("v")
    rows = docs.select("_source_id", "value", F.try_parse_json("value").alias("v"))
    wrong = lambda key: F.exists(_chosen(v, (key,)), lambda f: f["kind"] != "OBJECT")
    listless = lambda key: F.exists(_chosen(v, (key,)), lambda f: ~f["kind"].isin("ARRAY", "OBJECT", "STRING"))
    reason = (
        F.when(v.isNull(), "not valid JSON")
        .when(_kind(v) != "OBJECT", "not a JSON object")
        .when(wrong("location"), "location is not an object")
        .when(wrong("social_profiles"), "social_profiles is not an object")
        .when(listless("work_history"), "work_history is not a list")
        .when(listless("education_history"), "education_history is not a list")
    )
    rows = rows.withColumn("reason", reason)
    place, social = _get(v, "location"), _get(v, "social_profiles")
    work = F.filter(_list(_get(v, "work_history")), lambda x: _kind(x) == "OBJECT")
    study = F.filter(_list(_get(v, "education_history")), lambda x: _kind(x) == "OBJECT")
    experience = F.transform(work, lambda x: F.struct(_field(x, "company").alias("company"), _field(x, "title").alias("title"), _field(x, "experience_start", "").alias("start"), _field(x, "experience_end").alias("end"), _field(x, "summary").alias("summary")))
    education = F.transform(study, lambda x: F.struct(_field(x, "institution").alias("institution"), _field(x, "degree").alias("degree"), _field(x, "field_of_study").alias("field_of_study"), _field(x, "education_start").alias("start"), _field(x, "education_end").alias("end")))
    profiles = rows.filter("reason is null").select(
        _field(v, "full_name").alias("full_name"),
        _all(v, "emails").alias("emails"),
        _all(v, "phones").alias("phones"),
        F.struct(*[_field(place, k).alias(k) for k in ("city", "region", "country")]).alias("location"),
        F.struct(*[_field(social, k).alias(k) for k in ("linkedin", "github", "portfolio")], F.expr("cast(array() as array<string>)").alias("other")).alias("links"),
        F.coalesce(F.get(F.transform(F.slice(_chosen(v, KEYS["skills"]), 1, 1), lambda f: _strings(f["v"])), F.lit(0)), F.expr("cast(array() as array<string>)")).alias("skills"),
        F.filter(experience, lambda x: x["company"].isNotNull() & x["title"].isNotNull()).alias("experience"),
        F.filter(education, lambda x: x["institution"].isNotNull()).alias("education"),
        "_source_id",
        F.lit(source_type).alias("_source_type"),
    )
    return profiles, rows.filter("reason is not null").select("_source_id", "value", "reason")


def read_whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``_source_id, value``: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_source_id"), "value")


def read_json_profiles(spark: SparkSession, path: str | list[str], source_type: str = "ats") -> tuple[DataFrame, DataFrame]:
    """``(profiles, quarantine)`` of files that hold one JSON object each."""
    return map_json_documents(read_whole(spark, path), source_type)


# --- notes ----------------------------------------------------------------------------------------------------------

EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = r"\+?[0-9]{0,3} ?\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}"
URL = r"https?://[^\s<>\"')]+[^\s<>\"').,;]"


def extract_contacts(docs: DataFrame) -> DataFrame:
    """The built-in extractor: e-mail addresses, phone numbers and links of ``value``, without Python or a network."""
    urls = F.regexp_extract_all("value", F.lit(URL), F.lit(0))
    having = lambda host: F.get(F.filter(urls, lambda u: F.lower(u).contains(host)), F.lit(0))
    kind = lambda field: F.lit(None).cast(type_of(EXTRACTED, field)).alias(field)
    other = F.filter(urls, lambda u: ~F.lower(u).contains("linkedin.com") & ~F.lower(u).contains("github.com"))
    return docs.select(
        "_source_id",
        F.struct(
            kind("full_name"),
            F.array_distinct(F.regexp_extract_all("value", F.lit(EMAIL), F.lit(0))).alias("emails"),
            F.array_distinct(F.regexp_extract_all("value", F.lit(PHONE), F.lit(0))).alias("phones"),
            kind("location"),
            F.struct(having("linkedin.com").alias("linkedin"), having("github.com").alias("github"), F.lit(None).cast("string").alias("portfolio"), other.alias("other")).alias("links"),
            kind("skills"),
            kind("experience"),
            kind("education"),
        ).alias("extracted"),
    )


def python_extractor(function: Callable[[str], dict]) -> Callable[[DataFrame], DataFrame]:
    """An extractor from any function of text to a dict of the EXTRACTED shape, run over Arrow batches."""

    def apply(docs: DataFrame) -> DataFrame:
        from pyspark.sql.types import StringType, StructField, StructType

        schema = StructType([StructField("_source_id", StringType()), StructField("extracted", struct_of(EXTRACTED))])

        def per_batch(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame({"_source_id": pdf["_source_id"], "extracted": [function(t) for t in pdf["value"]]})

        return docs.select("_source_id", "value").mapInPandas(per_batch, schema)

    return apply


def map_extracted(rows: DataFrame, source_type: str = "recruiter_notes") -> DataFrame:
    """Raw profiles of rows ``_source_id, extracted``: strings are stripped, lists cleaned, unusable entries dropped."""
    e = F.col("extracted")
    text = lambda x, k, fallback=None: safe_str(x[k], fallback).alias(k)
    items = lambda k: F.coalesce(e[k], F.lit(None).cast(type_of(EXTRACTED, k)), F.expr(f"cast(array() as {type_of(EXTRACTED, k)})"))
    experience = F.transform(items("experience"), lambda x: F.struct(text(x, "company"), text(x, "title"), text(x, "start", ""), text(x, "end"), text(x, "summary")))
    education = F.transform(items("education"), lambda x: F.struct(*[text(x, k) for k in ("institution", "degree", "field_of_study", "start", "end")]))
    return rows.select(
        text(e, "full_name"),
        clean_list(e["emails"]).alias("emails"),
        clean_list(e["phones"]).alias("phones"),
        F.struct(*[text(e["location"], k) for k in ("city", "region", "country")]).alias("location"),
        F.struct(*[text(e["links"], k) for k in ("linkedin", "github", "portfolio")], clean_list(e["links"]["other"]).alias("other")).alias("links"),
        clean_list(e["skills"]).alias("skills"),
        F.filter(experience, lambda x: x["company"].isNotNull() & x["title"].isNotNull()).alias("experience"),
        F.filter(education, lambda x: x["institution"].isNotNull()).alias("education"),
        "_source_id",
        F.lit(source_type).alias("_source_type"),
    )


def read_notes(spark: SparkSession, path: str | list[str], extractor: Callable[[DataFrame], DataFrame] = extract_contacts) -> DataFrame:
    """Raw profiles of text files, one a file."""
    return map_extracted(extractor(read_whole(spark, path)))


# --- union ----------------------------------------------------------------------------------------------------------


def union_profiles(*sources: DataFrame) -> DataFrame:
    """One frame of raw profiles with an ``ordinal``: source kinds in their fixed order, then source ids.

    The ids of a range-sorted frame ascend over its partitions, so no task sees more than its own range.
    """
    every = sources[0]
    for other in sources[1:]:
        every = every.unionByName(other, allowMissingColumns=True)
    rank = F.coalesce(*[F.when(F.col("_source_type") == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    ordered = every.orderBy(rank, "_source_id").withColumn("ordinal", F.monotonically_increasing_id())
    return materialise(ordered.select(*struct_of(RAW_PROFILE).names), "profiles")


def empty_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], struct_of(RAW_PROFILE)).drop("ordinal")
