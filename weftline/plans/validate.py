"""Validation of canonical rows: what a merge guarantees, for entities that come from elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.normalize import strip


def normalised(entities: DataFrame) -> DataFrame:
    """Country stripped and upper-cased, names of skills, jobs and schools stripped, contact lists without repetitions."""
    place = F.col("location")
    renamed = lambda column, *keys: F.transform(column, lambda x: reduce(lambda acc, k: acc.withField(k, strip(x[k])), keys, x))
    return entities.withColumns(
        {
            "location": F.when(place.isNotNull(), place.withField("country", F.upper(strip(place["country"])))),
            "emails": F.array_distinct("emails"),
            "phones": F.array_distinct("phones"),
            "skills": renamed("skills", "name"),
            "experience": renamed("experience", "company", "title"),
            "education": renamed("education", "institution"),
        }
    )


def problems(entities: DataFrame) -> DataFrame:
    """``candidate_id, problem`` for every rule that a row breaks: required values and confidences between 0 and 1."""
    out_of_range = lambda c: c.isNull() | ~c.between(0, 1)
    lacking = lambda column, *keys: F.exists(column, lambda x: reduce(lambda a, b: a | b, [x[k].isNull() for k in keys]))
    rules: dict[str, Column] = {
        "candidate_id is missing": F.col("candidate_id").isNull(),
        "overall_confidence is not between 0 and 1": out_of_range(F.col("overall_confidence")),
        "a skill has no name": lacking("skills", "name"),
        "a skill's confidence is not between 0 and 1": F.exists("skills", lambda x: out_of_range(x["confidence"])),
        "a job has no company, title or start": lacking("experience", "company", "title", "start"),
        "a school has no name": lacking("education", "institution"),
        "an audit row is incomplete": lacking("provenance", "field", "source", "method", "value"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return entities.select("candidate_id", F.explode(broken).alias("problem"))


def checked(entities: DataFrame) -> DataFrame:
    """The normalised rows; evaluating a row that breaks a rule is an error."""
    rows = normalised(entities)
    ok = F.col("overall_confidence").between(0, 1) & F.forall("skills", lambda x: x["confidence"].between(0, 1)) & F.col("candidate_id").isNotNull()
    # The check is part of a column that is read, so it cannot be pruned away.
    return rows.withColumn("candidate_id", F.when(F.coalesce(ok, F.lit(False)), F.col("candidate_id")).otherwise(F.raise_error(F.concat(F.lit("invalid entity "), F.coalesce("candidate_id", F.lit("without an id")))).cast("string")))
