"""The whole run: sources, linkage, merge, limit, projection, sink."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.merge import consolidate
from weftline.plans.projection import Config, project_json
from weftline.sources import profiles as sources
from weftline.storage import materialise

log = logging.getLogger(__name__)


def load_config(path: str) -> Config:
    """Read and validate a projection configuration; it is a plan, so it is read by the driver."""
    return Config.parse(json.loads(Path(path).read_text(encoding="utf-8")))


def ingest(spark: SparkSession, json_path=None, notes_path=None, extractor: Callable[[DataFrame], DataFrame] = sources.extract_contacts) -> tuple[DataFrame, DataFrame | None]:
    """``(profiles, quarantine)`` of both kinds of source. A source that cannot be read is logged and left out."""
    found, quarantine = [], None
    if json_path:
        try:
            good, quarantine = sources.read_json_profiles(spark, json_path)
            found.append(good)
        except Exception as error:
            log.warning("JSON source %s is skipped: %s", json_path, error)
    if notes_path:
        try:
            found.append(sources.read_notes(spark, notes_path, extractor))
        except Exception as error:
            log.warning("notes source %s is skipped: %s", notes_path, error)
    return sources.union_profiles(*found) if found else sources.union_profiles(sources.empty_profiles(spark)), quarantine


def run(profiles: DataFrame, config: dict | Config, all_candidates: bool = False, linkage: str = "greedy") -> DataFrame:
    """``cluster_id, json`` of the first entity, or of all; the limit comes before the projection, whose errors it bounds."""
    entities = materialise(consolidate(profiles, linkage), "entities")
    chosen = entities if all_candidates else entities.orderBy("cluster_id").limit(1)
    return project_json(chosen, config, keep=["cluster_id"])


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document a line; the writer is Spark's own, so output is committed whole or not at all."""
    rows.select("json").write.text(path)
