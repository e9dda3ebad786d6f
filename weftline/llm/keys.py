"""Filtering documents by (doc_id, text hash) keys, without sorting their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Key tables of up to this many rows, counted first, are broadcast; larger ones meet the documents in a shuffled hash join.
BROADCAST_KEYS = 200_000


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each made longer until no column is called so, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_keys(docs: DataFrame, keys: DataFrame, how: str, rows: int) -> DataFrame:
    """``docs`` joined to ``keys`` (``k_id``, ``k_hash`` and any other columns) on doc_id, null-safe, and xxhash64 of the text.

    ``rows`` is the number of rows of ``keys``, or of what they hold if that is more.
    """
    keys = F.broadcast(keys) if rows <= BROADCAST_KEYS else keys.hint("shuffle_hash")
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["k_id"]) & (F.xxhash64(docs["text"]) == keys["k_hash"]), how)
