"""The projection compiler: a configuration of paths, formats and missing-value policies becomes Columns.

Every resolved path is a pair (present, value): a null value of a present path is not the same as an absent path, and
policies apply to absence only. The output is a tree of such pairs, written as JSON text with absent keys left out, or as
a typed struct with absent values null and their paths listed.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.formats import FORMATS, Format

log = logging.getLogger(__name__)

# Policies and flags of a configuration.
POLICIES = ("null", "omit", "error")
FLAGS = ("include_overall_confidence", "include_provenance")

_BRACKET = re.compile(r"(.+?)\[(-?\d*)\]")


@dataclass
class Value:
    """A resolved path; ``column`` is None if the path is absent whatever the row."""

    present: Column | None
    column: Column | None
    kind: T.DataType


MISSING = Value(None, None, T.NullType())


def split_path(path: str) -> list[str]:
    """Segments between dots; empty ones are dropped, so ``.`` is the whole record."""
    return [s for s in path.split(".") if s]


def _field(v: Value, name: str) -> Value:
    if v.column is None or not isinstance(v.kind, T.StructType) or name not in v.kind.names:
        return MISSING
    return Value(v.present & v.column.isNotNull(), v.column.getField(name), v.kind[name].dataType)


def resolve(v: Value, segments: list[str]) -> Value:
    """Follow ``name``, ``name[N]`` and ``name[]`` from a value."""
    if not segments or v.column is None:
        return v
    bracket = _BRACKET.fullmatch(segments[0])
    if not bracket:
        return resolve(_field(v, segments[0]), segments[1:])
    name, index = bracket.groups()
    array = _field(v, name)
    if array.column is None or not isinstance(array.kind, T.ArrayType) or index == "-":
        return MISSING
    present, item = array.present & array.column.isNotNull(), array.kind.elementType
    if index:
        n = int(index)
        at = F.get(array.column, F.lit(n)) if n >= 0 else F.try_element_at(array.column, F.lit(n))
        inside = F.size(array.column) > n if n >= 0 else F.size(array.column) >= -n
        return resolve(Value(present & inside, at, item), segments[1:])
    if not segments[1:]:
        return Value(present, array.column, array.kind)
    inner = resolve(Value(F.lit(True), F.lit(None).cast(item), item), segments[1:])
    if inner.column is None:
        return Value(present, F.expr("array()"), T.ArrayType(T.StringType()))

    def pluck(x: Column) -> Column:
        got = resolve(Value(F.lit(True), x, item), segments[1:])
        return F.when(got.present, got.column)

    return Value(present, F.filter(F.transform(array.column, pluck), lambda x: x.isNotNull()), T.ArrayType(inner.kind))


@dataclass
class Spec:
    source: str
    path: str
    on_missing: str
    format: str | None = None


@dataclass
class Config:
    """A validated configuration."""

    fields: list[Spec] = field(default_factory=list)
    flags: dict[str, bool] = field(default_factory=dict)

    @classmethod
    def parse(cls, config: dict) -> Config:
        if not isinstance(config, dict):
            raise TypeError(f"a configuration is a dict, not {type(config).__name__}")
        flags = config.get("flags") or {}
        for name in flags:
            if name not in FLAGS:
                log.warning("unknown flag %r is ignored", name)
        specs = config.get("fields", [])
        if not isinstance(specs, list):
            raise ValueError("fields is a list")
        return cls([_parse_spec(s, i) for i, s in enumerate(specs)], {f: bool(flags.get(f, False)) for f in FLAGS})


def _parse_spec(spec, index: int) -> Spec:
    if not isinstance(spec, dict):
        raise ValueError(f"field {index} is not an object")
    for key in ("from", "path"):
        if not isinstance(spec.get(key), str) or not spec[key].strip():
            raise ValueError(f"field {index} needs a non-blank {key!r}")
    if spec.get("on_missing") not in POLICIES:
        raise ValueError(f"field {index}: on_missing is one of {', '.join(POLICIES)}")
    name = spec.get("format")
    if name is not None and (not isinstance(name, str) or not name.strip()):
        raise ValueError(f"field {index}: format is null or a non-blank name")
    return Spec(spec["from"].strip(), spec["path"].strip(), spec["on_missing"], name.strip() if name else None)


def _formatted(v: Value, spec: Spec, formats: dict[str, Format]) -> Value:
    if spec.format is None or v.column is None:
        return v
    if spec.format not in formats:
        # Only a row in which the path is present meets the unknown name.
        return Value(v.present, F.when(v.present, F.raise_error(F.lit(f"unknown format {spec.format!r} of {spec.source!r}")).cast("string")), T.StringType())
    column, kind = formats[spec.format](v.column, v.kind)
    return Value(v.present, F.when(v.present, column), kind)


@dataclass
class _Write:
    """One write of the output: its place in the order of writes, whether it happens, and what."""

    order: int
    value: Value


@dataclass
class _Node:
    writes: list[_Write] = field(default_factory=list)
    children: dict[str, _Node] = field(default_factory=dict)


def _tree(record: Value, config: Config, formats: dict[str, Format]) -> _Node:
    root = _Node()

    def put(path: str, value: Value) -> None:
        node = root
        parts = split_path(path)
        for part in parts:
            node = node.children.setdefault(part, _Node())
        if parts:
            order = put.order = put.order + 2  # the odd numbers are for fields of whole objects
            node.writes.append(_Write(order, value))

    put.order = 0
    for spec in config.fields:
        v = resolve(record, split_path(spec.source))
        if isinstance(v.column, _Fields):
            v = Value(v.present, v.column.whole, v.kind)
        v = _formatted(v, spec, formats)
        absent = F.lit(True) if v.column is None else ~v.present
        if spec.on_missing == "omit":
            if v.column is not None:
                put(spec.path, v)
            continue
        empty = F.lit(None).cast("string") if v.column is None else F.lit(None).cast(v.kind)
        if spec.on_missing == "error":
            fail = F.raise_error(F.lit(f"{spec.source!r} is missing"))
            empty = fail.cast("string") if v.column is None else fail.cast("string").cast(v.kind) if not isinstance(v.kind, (T.ArrayType, T.StructType)) else F.from_json(fail.cast("string"), v.kind)
        filled = empty if v.column is None else F.when(absent, empty).otherwise(v.column)
        put(spec.path, Value(F.lit(True), filled, T.StringType() if v.column is None else v.kind))
    if config.flags.get("include_overall_confidence"):
        v = resolve(record, ["overall_confidence"])
        put("overall_confidence", Value(F.lit(True), F.lit(None).cast("double") if v.column is None else v.column, v.kind if v.column is not None else T.DoubleType()))
    if config.flags.get("include_provenance"):
        v = resolve(record, ["provenance"])
        kind = T.ArrayType(T.StringType()) if v.column is None else v.kind
        put("provenance", Value(F.lit(True), F.expr("array()").cast(kind) if v.column is None else v.column, kind))
    return root


def _last(node: _Node) -> Column:
    """The order of the last write that happens at this very node in a row; 0 if none does."""
    return F.greatest(F.lit(0), F.lit(0), *[F.when(w.value.present, F.lit(w.order)).otherwise(F.lit(0)) for w in node.writes])


def _text(v: Column) -> Column:
    """JSON text of any value; a null is written as null."""
    s = F.to_json(F.array(v), {"ignoreNullFields": "false"})
    return F.substring(s, F.lit(2), F.length(s) - 2)


def _writes_below(node: _Node) -> list[_Write]:
    return [w for c in node.children.values() for w in (*c.writes, *_writes_below(c))]


def _opened(node: _Node) -> _Node:
    """The node, with the fields of an object written whole as children if later writes go into that object."""
    below = max((w.order for w in _writes_below(node)), default=0)
    whole = [w for w in node.writes if isinstance(w.value.kind, T.StructType) and w.order < below]
    if not whole:
        return node
    children = {k: _Node(list(c.writes), c.children) for k, c in node.children.items()}
    for w in whole:
        present = w.value.present & w.value.column.isNotNull()
        for f in w.value.kind.fields:
            children.setdefault(f.name, _Node()).writes.append(_Write(w.order + 1, Value(present, w.value.column.getField(f.name), f.dataType)))
    for c in children.values():
        c.writes.sort(key=lambda w: w.order)
    # Fields of one object share an order and keep their places in it.
    place = {f.name: i for w in whole for i, f in enumerate(w.value.kind.fields)}
    first = lambda k: (min(w.order for w in (*children[k].writes, *_writes_below(children[k]))), place.get(k, -1))
    return _Node(node.writes, {k: children[k] for k in sorted(children, key=first)})


def _render(node: _Node, after: Column | None) -> tuple[Column, Column]:
    """(does the node exist, its JSON text), counting writes with an order above ``after`` only."""
    node = _opened(node)
    live = [(w, w.value.present if after is None else w.value.present & (F.lit(w.order) > after)) for w in node.writes]
    leaf = None
    for w, ok in live:
        # Later writes win, so they are asked first.
        text = _text(w.value.column)
        leaf = F.when(ok, text) if leaf is None else F.when(ok, text).otherwise(leaf)
    here = reduce(lambda a, b: a | b, [ok for _, ok in live]) if live else F.lit(False)
    if not node.children:
        return here, leaf
    if node.writes:
        floor = F.greatest(_last(node), F.lit(0) if after is None else after)
        inside, text = _object(node, floor)
        return here | inside, F.when(inside, text).otherwise(leaf)
    return _object(node, after)


def _object(node: _Node, after: Column | None) -> tuple[Column, Column]:
    """(has it any member, JSON text of the members). A key's place is that of its first write in the configuration."""
    members = {k: _render(c, after) for k, c in node.children.items()}
    parts = [F.when(ok, F.concat(F.lit(_quoted(k) + ": "), text)) for k, (ok, text) in members.items()]
    some = reduce(lambda a, b: a | b, [ok for ok, _ in members.values()])
    return some, F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def _quoted(key: str) -> str:
    import json

    return json.dumps(key, ensure_ascii=False)


def _record(df: DataFrame) -> Value:
    return Value(F.lit(True), F.struct(*[df[c] for c in df.columns]), df.schema)


def _root(df: DataFrame, path_source: Config, formats: dict[str, Format] | None) -> _Node:
    top = _record(df)
    # Fields of the record are the columns themselves, so that scans are pruned to what paths name.
    record = _Columns(top.present, top.column, top.kind, {c: df[c] for c in df.columns})
    return _tree(record, path_source, FORMATS | (formats or {}))


class _Columns(Value):
    """The whole record: its fields are columns."""

    def __init__(self, present, column, kind, columns):
        super().__init__(present, _Fields(column, columns), kind)


class _Fields:
    """Stands for a struct of all columns; ``getField`` gives the column itself."""

    def __init__(self, whole: Column, columns: dict[str, Column]):
        self.whole, self.columns = whole, columns

    def getField(self, name: str) -> Column:  # noqa: N802
        return self.columns[name]

    def isNotNull(self) -> Column:  # noqa: N802
        return F.lit(True)


def project_json(df: DataFrame, config: dict | Config, keep: list[str] = (), formats: dict[str, Format] | None = None) -> DataFrame:
    """``keep`` columns and ``json``: each row's output as JSON text. Limit ``df`` first: errors rise for every row given."""
    config = config if isinstance(config, Config) else Config.parse(config)
    root = _root(df, config, formats)
    text = _object(root, None)[1] if root.children else F.lit("{}")
    return df.select(*keep, text.alias("json"))


def project_struct(df: DataFrame, config: dict | Config, keep: list[str] = (), formats: dict[str, Format] | None = None) -> DataFrame:
    """``keep`` columns, one column an output path (nested as structs), and ``_omitted``: paths absent from the row.

    Several writes of one path have to agree in type; the last that happens wins.
    """
    config = config if isinstance(config, Config) else Config.parse(config)
    root = _root(df, config, formats)
    omitted: list[Column] = []

    def build(node: _Node, path: str) -> Column:
        if node.children:
            if node.writes:
                raise ValueError(f"{path!r} is both a value and an object")
            return F.struct(*[build(c, f"{path}.{k}".lstrip(".")).alias(k) for k, c in node.children.items()])
        omitted.append(F.when(~reduce(lambda a, b: a | b, [w.value.present for w in node.writes]), F.lit(path)))
        return F.coalesce(*[F.when(w.value.present, w.value.column) for w in reversed(node.writes)]) if len(node.writes) > 1 else F.when(node.writes[0].value.present, node.writes[0].value.column)

    columns = [build(c, k).alias(k) for k, c in root.children.items()]
    return df.select(*keep, *columns, F.array_compact(F.array(*omitted)).alias("_omitted") if omitted else F.array().cast("array<string>").alias("_omitted"))
