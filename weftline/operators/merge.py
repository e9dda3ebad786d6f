"""Merging the records of each cluster into one entity, with an ordered audit trail.

Records of a cluster are ranked by the weight of their source, then by ordinal. As the weight never rises along that
order, the first usable value of a field is the one that stays; later ones only leave audit rows. Every field is a window
over (cluster, rank); its items and audit rows are collected by one final aggregation. All windows and the aggregation
are keyed by cluster first, so one exchange by cluster serves them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.normalize import clean_list, email_key, safe_str, source_weight, strip, try_country, try_date, try_phone
from weftline.operators.link import link
from weftline.schemas import CANONICAL, struct_of, type_of
from weftline.storage import materialise

# What an audit row says has happened.
INITIAL, OVERRIDE, HELD, UNION, SOURCE_ADDED, CONFIRMED = "initial_write", "confidence_override", "confidence_held", "array_union", "skill_source_added", "duplicate_confirmed"

#: Stages of a record's audit rows, in the order in which they are written.
STAGES = ("full_name", "emails", "phones", "skills", "experience", "education", "location", "links")

_EVENT = ("rank", "stage", "phase", "pos", "field", "source", "method", "value")


def resolve_scalar(current: Column, current_weight: Column, incoming: Column, incoming_weight: Column) -> dict[str, Column]:
    """One step of scalar resolution: ``value``, ``weight`` and the audit ``method`` and ``logged`` value (null: none).

    A blank incoming value changes nothing; a blank current one is filled; values equal but for case are left; a strictly
    higher weight overrides; otherwise the current value is held.
    """
    now, new = safe_str(current), safe_str(incoming)
    fill = now.isNull() & new.isNotNull()
    differ = now.isNotNull() & new.isNotNull() & (F.lower(now) != F.lower(new))
    over = differ & (incoming_weight > current_weight)
    take = F.coalesce(fill, F.lit(False)) | F.coalesce(over, F.lit(False))
    return {
        "value": F.when(take, new).otherwise(now),
        "weight": F.when(take, incoming_weight).otherwise(current_weight),
        "method": F.when(fill, INITIAL).when(over, OVERRIDE).when(differ, HELD),
        "logged": F.when(fill | over, new).when(differ, now),
    }


def entity_id(emails: Column, phones: Column) -> Column:
    """``cand-`` and twelve hex digits of the SHA-256 of the sorted distinct keys; random where there are none."""
    keys = F.array_sort(F.array_distinct(F.concat(emails, phones)))
    return F.when(F.size(keys) > 0, F.concat(F.lit("cand-"), F.substring(F.sha2(F.array_join(keys, "|"), 256), 1, 12))).otherwise(F.concat(F.lit("cand-"), F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 12)))


def ranked(profiles: DataFrame, clusters: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Profiles with ``cluster_id, weight, rank`` and defaults for what a source left out."""
    p = profiles.join(clusters, "ordinal").withColumn("weight", source_weight(F.col("_source_type"), weights))
    p = p.withColumns({"_source_type": F.coalesce("_source_type", F.lit("unknown")), "_source_id": F.coalesce("_source_id", F.lit("unknown"))})
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "ordinal")))


def _base(p: DataFrame, *more) -> DataFrame:
    return p.select("cluster_id", "rank", "weight", F.col("_source_type").alias("source"), *more)


def _event(df: DataFrame, stage: str, field: Column, method: Column, value: Column, phase: int = 0, pos: Column | None = None) -> DataFrame:
    pos = F.lit(0) if pos is None else pos
    return df.select("cluster_id", "rank", F.lit(STAGES.index(stage)).alias("stage"), F.lit(phase).alias("phase"), pos.cast("int").alias("pos"), field.alias("field"), "source", method.alias("method"), value.alias("value"))


def _along(order: str = "rank"):
    return Window.partitionBy("cluster_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def merge_scalar(p: DataFrame, value: Column, stage: str, field: str, pos: int = 0, first_value: Column | None = None) -> tuple[DataFrame, Column]:
    """Audit rows of one scalar field, and the aggregate that gives the winner.

    ``first_value`` is what an initial write logs if that differs from the value that stays.
    """
    rows = _base(p, value.alias("v"), (value if first_value is None else first_value).alias("raw")).filter("v is not null")
    rows = rows.withColumn("winner", F.first("v").over(_along())).withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("rank")))
    rows = rows.filter((F.col("n") == 1) | (F.lower("v") != F.lower("winner")))
    first = F.col("n") == 1
    events = _event(rows, stage, F.lit(field), F.when(first, INITIAL).otherwise(HELD), F.when(first, F.col("raw")).otherwise(F.col("winner")), pos=F.lit(pos))
    return events, F.min(F.when(value.isNotNull(), F.struct("rank", value.alias("v"))))["v"]


def merge_contacts(p: DataFrame, column: str, key) -> tuple[DataFrame, DataFrame]:
    """Audit rows and items of e-mails or phones: the first of each key stays; what has no key vanishes."""
    rows = _base(p, F.posexplode(F.coalesce(F.col(column), F.array().cast("array<string>"))).alias("pos", "raw")).withColumn("key", key(F.col("raw"))).filter("key is not null and key <> ''")
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id", "key").orderBy("rank", "pos"))).filter("n = 1")
    return _event(one, column, F.lit(column), F.lit(UNION), F.col("raw"), pos=F.col("pos")), one.select("cluster_id", F.lit(column).alias("kind"), "rank", "pos", F.col("key").alias("text"))


def merge_skills(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audit rows and items ``name, confidence, sources``: the first spelling stays, each source type counts once."""
    rows = _base(p, F.posexplode(F.coalesce("skills", F.array().cast("array<string>"))).alias("pos", "raw")).withColumn("name", strip(F.col("raw"))).filter("name <> ''").withColumn("key", F.lower("name"))
    by_key = Window.partitionBy("cluster_id", "key").orderBy("rank", "pos")
    rows = rows.withColumns({"n": F.row_number().over(by_key), "first": F.first("name").over(by_key), "by_source": F.row_number().over(Window.partitionBy("cluster_id", "key", "source").orderBy("rank", "pos"))}).filter("by_source = 1")
    new = F.col("n") == 1
    events = _event(rows, "skills", F.concat(F.lit("skills["), F.col("first"), F.lit("]")), F.when(new, INITIAL).otherwise(SOURCE_ADDED), F.col("first"), pos=F.col("pos"))
    items = rows.groupBy("cluster_id", "key").agg(F.min(F.struct("rank", "pos", "first")).alias("at"), F.max("weight").alias("confidence"), F.array_sort(F.collect_list(F.struct("rank", "pos", "source"))).alias("by"))
    return events, items.select("cluster_id", "at.rank", "at.pos", F.struct(F.col("at.first").alias("name"), "confidence", F.transform("by", lambda x: x["source"]).alias("sources")).alias("skill"))


def _dated(c: Column) -> Column:
    """Normalised date, or the raw string where that fails; null where blank."""
    s = safe_str(c)
    return F.coalesce(try_date(s), s)


def merge_entries(p: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """Audit rows and items of experience or education: the first entry of a key stays whole, later ones confirm it."""
    kind = type_of(CANONICAL, stage)
    x = F.col("x")
    rows = _base(p, F.posexplode(F.coalesce(F.col(stage), F.expr(f"cast(array() as {kind})"))).alias("pos", "x"))
    if stage == "experience":
        item = F.struct(safe_str(x["company"]).alias("company"), safe_str(x["title"]).alias("title"), F.coalesce(_dated(x["start"]), F.lit("")).alias("start"), _dated(x["end"]).alias("end"), safe_str(x["summary"]).alias("summary"))
        rows = rows.withColumn("item", item).filter("item.company is not null and item.title is not null")
        key = F.concat_ws("||", F.lower("item.company"), F.lower("item.title"))
        field = F.concat(F.lit("experience["), F.col("item.company"), F.lit("|"), F.col("item.title"), F.lit("]"))
        short = F.concat_ws(" / ", "item.company", "item.title")
        long = F.concat(short, F.lit(" ("), F.col("item.start"), F.lit(" → "), F.coalesce("item.end", F.lit("Present")), F.lit(")"))
    else:
        item = F.struct(safe_str(x["institution"]).alias("institution"), safe_str(x["degree"]).alias("degree"), safe_str(x["field_of_study"]).alias("field_of_study"), _dated(x["start"]).alias("start"), _dated(x["end"]).alias("end"))
        rows = rows.withColumn("item", item).filter("item.institution is not null")
        key = F.lower("item.institution")
        field = F.concat(F.lit("education["), F.col("item.institution"), F.lit("]"))
        short = long = F.col("item.institution")
    rows = rows.withColumn("key", key).withColumn("n", F.row_number().over(Window.partitionBy("cluster_id", "key").orderBy("rank", "pos")))
    written = _event(rows, stage, field, F.lit(INITIAL), long, pos=F.col("pos"))
    again = _event(rows.filter("n > 1"), stage, field, F.lit(CONFIRMED), short, phase=1, pos=F.col("pos"))
    return written.union(again), rows.filter("n = 1").select("cluster_id", "rank", "pos", F.col("item").alias(stage))


def merge(profiles: DataFrame, clusters: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row a cluster: ``cluster_id`` and the CANONICAL columns, ``provenance`` in the order of a sequential merge."""
    p = ranked(profiles, clusters, weights)
    place = {k: safe_str(F.col(f"location.{k}")) for k in ("city", "region")}
    raw_country = F.coalesce(try_country(safe_str(F.col("location.country"))), safe_str(F.col("location.country")))
    links = {k: safe_str(F.col(f"links.{k}")) for k in ("linkedin", "github", "portfolio")}
    p = p.withColumns({f"_{k}": v for k, v in (place | links).items()} | {"_raw_country": raw_country, "_name": safe_str(F.col("full_name")), "_other": clean_list(F.col("links.other"))})
    p = p.withColumn("_country", F.upper("_raw_country"))
    built = lambda *cs: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cs])
    p = p.withColumns({"_placed": built("_city", "_region", "_raw_country"), "_linked": built("_linkedin", "_github", "_portfolio") | (F.size("_other") > 0)})
    first_place = F.min(F.when(F.col("_placed"), F.col("rank"))).over(Window.partitionBy("cluster_id"))
    # The country of the first record that has a location is logged as it was written.
    p = p.withColumn("_logged_country", F.when(F.col("rank") == first_place, F.col("_raw_country")).otherwise(F.col("_country")))
    # Every field has a branch of its own; ranks and cleaned values are made once for all of them.
    p = materialise(p, "ranked")

    events, winners = [], {}
    scalars = [("full_name", "full_name", "_name", 0)] + [("location", f"location.{k}", f"_{k}", i) for i, k in enumerate(("city", "region", "country"))] + [("links", f"links.{k}", f"_{k}", i) for i, k in enumerate(links)]
    for stage, field, column, pos in scalars:
        made, winners[field] = merge_scalar(p, F.col(column), stage, field, pos, F.col("_logged_country") if column == "_country" else None)
        events.append(made)
    emails, email_items = merge_contacts(p, "emails", email_key)
    phones, phone_items = merge_contacts(p, "phones", try_phone)
    skills, skill_items = merge_skills(p)
    experience, experience_items = merge_entries(p, "experience")
    education, education_items = merge_entries(p, "education")
    log = reduce(DataFrame.union, [*events, emails, phones, skills, experience, education])

    # One tagged frame, one aggregation: scalars, items and audit rows meet by cluster.
    heads = p.select("cluster_id", "rank", "weight", "_source_id", *[c for _, _, c, _ in scalars], "_other", "_placed", "_linked")
    parts = [
        heads.withColumn("part", F.lit("head")),
        email_items.unionByName(phone_items).withColumn("part", F.lit("contact")),
        skill_items.withColumn("part", F.lit("skill")),
        experience_items.withColumn("part", F.lit("experience")),
        education_items.withColumn("part", F.lit("education")),
        log.select("cluster_id", F.lit("event").alias("part"), F.struct(*_EVENT).alias("event")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    listed = lambda when, *cs: F.array_sort(F.collect_list(F.when(when, F.struct(*cs))))
    part = lambda name: F.col("part") == name
    grouped = every.groupBy("cluster_id").agg(
        *[w.alias(f) for f, w in ((f.replace(".", "_"), w) for f, w in winners.items())],
        F.max("weight").alias("weight"),
        listed(part("head"), "rank", "_source_id").alias("ids"),
        listed(part("head") & F.col("_linked"), "rank", "_other").alias("others"),
        F.max("_placed").alias("placed"),
        F.max("_linked").alias("linked"),
        listed(part("contact") & (F.col("kind") == "emails"), "rank", "pos", "text").alias("emails"),
        listed(part("contact") & (F.col("kind") == "phones"), "rank", "pos", "text").alias("phones"),
        listed(part("skill"), "rank", "pos", "skill").alias("skills"),
        listed(part("experience"), "rank", "pos", "experience").alias("experience"),
        listed(part("education"), "rank", "pos", "education").alias("education"),
        listed(part("event"), "event.rank", "event.stage", "event.phase", "event.pos", "event").alias("log"),
    )
    only = lambda column, item: F.transform(column, lambda x: x[item])
    flat = F.flatten(only("others", "_other"))
    # The other links of a single record keep their repetitions.
    other = F.when(F.size("others") > 1, F.array_distinct(flat)).otherwise(flat)
    out = grouped.select(
        "cluster_id",
        "full_name",
        only("emails", "text").alias("emails"),
        only("phones", "text").alias("phones"),
        F.when(F.col("placed"), F.struct(*[F.col(f"location_{k}").alias(k) for k in ("city", "region", "country")])).alias("location"),
        F.when(F.col("linked"), F.struct(*[F.col(f"links_{k}").alias(k) for k in links], other.alias("other"))).alias("links"),
        only("skills", "skill").alias("skills"),
        only("experience", "experience").alias("experience"),
        only("education", "education").alias("education"),
        F.round("weight", 4).alias("overall_confidence"),
        F.transform("log", lambda x: F.struct(*[x["event"][k].alias(k) for k in ("field", "source", "method", "value")])).alias("provenance"),
        F.array_distinct(only("ids", "_source_id")).alias("raw_sources"),
    )
    return out.select("cluster_id", entity_id(F.col("emails"), F.col("phones")).alias("candidate_id"), *[c for c in struct_of(CANONICAL).names if c != "candidate_id"])


def consolidate(profiles: DataFrame, linkage: str = "greedy", weights: dict[str, float] | None = None) -> DataFrame:
    """Link and merge: one canonical row an entity. Order by ``cluster_id`` for the order in which clusters began."""
    return merge(profiles, link(profiles, linkage), weights)
