"""Record linkage on shared contact keys.

``transitive`` linkage is plain connected components of the record-key graph. ``greedy`` linkage, the default, is that of
a single pass in ordinal order: a record joins the FIRST cluster with one of its keys and adds its keys to it; clusters
never merge with one another. Greedy clusters never cross components, and order inside a component is all that matters,
so only components that the two could tell apart are treated further: of three records or more, and without a key that
all of their records share. Those of up to ``REPLAYED`` records are replayed in one task each.

For larger ones the pass is a fixed point: a cluster holds a key if an earlier member has it, so a record's cluster is the
least one among all earlier records that share a key, and the record itself if there is none. Every record's label starts
as its ordinal; a round takes the least label before it along each of its keys, then the label of that label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.normalize import email_key, try_phone
from weftline.operators.components import connected_components
from weftline.storage import materialise

#: Records of a component that one task replays; both ways give the same clusters.
REPLAYED = 10_000
#: Ordinals that one task orders along a key in a round, so that a key of very many records is split.
SPAN = 100_000


def match_keys(profiles: DataFrame) -> DataFrame:
    """``ordinal, kind, key``: the distinct normalised e-mail and phone keys of every record; what fails is left out."""
    both = F.concat(
        F.transform(F.coalesce("emails", F.array().cast("array<string>")), lambda x: F.struct(F.lit("email").alias("kind"), email_key(x).alias("key"))),
        F.transform(F.coalesce("phones", F.array().cast("array<string>")), lambda x: F.struct(F.lit("phone").alias("kind"), try_phone(x).alias("key"))),
    )
    rows = profiles.select("ordinal", F.explode(F.array_distinct(both)).alias("k")).select("ordinal", "k.kind", "k.key")
    return rows.filter("key is not null and key <> ''")


def key_overlap(keys: DataFrame) -> DataFrame:
    """``ordinal, first``: for every record, the earliest record that shares one of its keys (itself, if none does).

    The least ordinal of a key is a partial aggregate; records are never paired with one another, so a key that very
    many records share costs one row a record.
    """
    least = keys.groupBy("kind", "key").agg(F.min("ordinal").alias("first"))
    return keys.join(least, ["kind", "key"]).groupBy("ordinal").agg(F.min("first").alias("first"))


def components(keys: DataFrame) -> DataFrame:
    """``ordinal, component`` for records that share a key with another; the component is its least ordinal."""
    least = keys.groupBy("kind", "key").agg(F.min("ordinal").alias("first"))
    edges = keys.join(least, ["kind", "key"]).filter("ordinal <> first").select("ordinal", "first")
    return connected_components(edges, "ordinal", "first").select(F.col("node").alias("ordinal"), "component")


def _replay(pdf):
    """The greedy pass over one component: rows (ordinal, keys)."""
    import pandas as pd

    pdf = pdf.sort_values("ordinal")
    seeds, holder, out = [], {}, []  # holder: key -> the first cluster that has it
    for ordinal, keys in zip(pdf["ordinal"], pdf["keys"], strict=True):
        at = min((holder[k] for k in keys if k in holder), default=len(seeds))
        if at == len(seeds):
            seeds.append(ordinal)
        for k in keys:
            holder[k] = min(at, holder.get(k, at))
        out.append(seeds[at])
    return pd.DataFrame({"ordinal": pdf["ordinal"].to_numpy(), "cluster_id": out})


def _flow(member: DataFrame) -> DataFrame:
    """``ordinal, cluster_id`` of the greedy pass by label rounds over rows ``ordinal, kind, key``."""
    block = F.floor(F.col("ordinal") / SPAN)
    label = materialise(member.select("ordinal", F.col("ordinal").alias("label")).distinct(), "labels")
    total = None
    while True:
        rows = member.join(label, "ordinal").withColumn("block", block)
        earlier = lambda order, *by: F.min("label").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        # Along a key: the least label in the blocks before, and in the record's own block.
        blocks = rows.groupBy("kind", "key", "block").agg(F.min("label").alias("label"))
        blocks = blocks.select("kind", "key", "block", earlier("block", "kind", "key").alias("before"))
        rows = rows.withColumn("within", earlier("ordinal", "kind", "key", "block")).join(blocks, ["kind", "key", "block"])
        least = rows.groupBy("ordinal").agg(F.min(F.least("label", "within", "before")).alias("label"))
        least = materialise(least, "labels")
        label = materialise(least.join(least.select(F.col("ordinal").alias("label"), F.col("label").alias("further")), "label").select("ordinal", F.col("further").alias("label")), "labels")
        # Labels only ever fall, so an equal sum means that none has changed.
        now = label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return label.withColumnRenamed("label", "cluster_id")
        total = now


def linked(profiles: DataFrame, linkage: str = "greedy") -> DataFrame:
    """``ordinal, component, cluster_id`` for every record; both are named by their first record. Records without keys stand alone."""
    if linkage not in ("greedy", "transitive"):
        raise ValueError(f"linkage is greedy or transitive, not {linkage}")
    keys = materialise(match_keys(profiles), "match-keys")
    parts = materialise(components(keys), "linked")
    everyone = profiles.select("ordinal")
    if linkage == "transitive":
        component = F.coalesce("component", "ordinal")
        return everyone.join(parts, "ordinal", "left").select("ordinal", component.alias("component"), component.alias("cluster_id"))
    member = keys.join(parts, "ordinal")
    sizes = parts.groupBy("component").agg(F.count("*").alias("records"))
    widest = member.groupBy("component", "kind", "key").agg(F.count("*").alias("n")).groupBy("component").agg(F.max("n").alias("widest"))
    open_parts = materialise(sizes.join(widest, "component").filter("records > 2 and widest < records").select("component", "records"), "open")
    small = member.join(open_parts.filter(F.col("records") <= REPLAYED), "component").groupBy("component", "ordinal").agg(F.sort_array(F.collect_set(F.concat_ws(":", "kind", "key"))).alias("keys"))
    replayed = materialise(small.groupBy("component").applyInPandas(_replay, "ordinal long, cluster_id long"), "replayed")
    large = open_parts.filter(F.col("records") > REPLAYED)
    if not large.isEmpty():
        replayed = replayed.union(_flow(materialise(member.join(large, "component", "left_semi").select("ordinal", "kind", "key"), "large")))
    both = parts.join(replayed, "ordinal", "left").select("ordinal", "component", F.coalesce("cluster_id", "component").alias("cluster_id"))
    return everyone.join(both, "ordinal", "left").select("ordinal", F.coalesce("component", "ordinal").alias("component"), F.coalesce("cluster_id", "ordinal").alias("cluster_id"))


def link(profiles: DataFrame, linkage: str = "greedy") -> DataFrame:
    """``ordinal, cluster_id`` for every record."""
    return linked(profiles, linkage).select("ordinal", "cluster_id")
