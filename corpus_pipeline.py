"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before has kept; ``run`` writes each stage's
rows to the shared folder and reads them back for the next. All but the last keep the columns of ``docs``.

Defined cases, besides those of the operators: only documents of one group of linked fingerprints remove one another,
whatever doc_ids they repeat or lack; a document without doc_id stays if its group has none with one and its text hash is
the least; of rows equal in doc_id and text one stays; a benchmark table without rows removes nothing; an empty table
stays empty; columns of any name keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, langid, packing, pii, simhash
from weftline.llm.keys import join_keys
from weftline.storage import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language is rejected or undetermined."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the least doc_id, of several the least text hash."""
    rows = simhash.near_duplicates(docs).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = materialise(rows, "near-duplicates")
    # A null doc_id comes after all others. The first of a group is a partial aggregate, however large the group is.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = rows.groupBy(F.col("component").alias("c")).agg(first)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    keys = materialise(rows.join(kept, F.col("component") == F.col("c")).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "n", stays.alias("kept")), "keys")
    gone, often = keys.filter("not kept").select("k_id", "k_hash"), keys.filter("kept and n > 1").select("k_id", "k_hash")
    n_gone, n_often = gone.count(), often.count()
    out = join_keys(docs, gone, "left_anti", n_gone)
    if not n_often:
        return out
    # Rows that are equal in doc_id and text: the one whose columns have the least hash stays.
    same = join_keys(docs, often, "left_semi", n_often)
    hashed = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = same.groupBy(docs["doc_id"], F.xxhash64(docs["text"])).agg(F.min_by(F.struct(*(docs[c] for c in docs.columns)), F.xxhash64(*hashed)).alias("row")).select("row.*")
    return join_keys(out, often, "left_anti", n_often).union(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which an item of the benchmark is found."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids."""
    return packing.pack_documents(docs, keep_ids=False, memo=30_000, block=2_000_000)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Hashes, learned models and tokenizer ids are beyond SQL; tests/llm compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
