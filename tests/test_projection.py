import json

import pytest
from pyspark.errors import PySparkException

from weftline.plans.projection import Config, project_json, project_struct, split_path

SCHEMA = "id long, name string, tags array<string>, loc struct<city:string, code:string>, items array<struct<k:string, n:array<long>>>, overall_confidence double"
ROWS = [
    (1, "ann", ["x", None, "z"], ("Rome", None), [("a", [1, 2]), (None, []), ("c", None)], 0.5),
    (2, None, [], None, None, None),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def project(df, *fields, **config):
    keys = ("from", "path", "on_missing", "format")
    out = project_json(df, {"fields": [dict(zip(keys, f)) for f in fields], **config}, keep=["id"]).orderBy("id").collect()
    return [json.loads(r.json) for r in out]


def test_paths(df):
    got = project(df, ("name", "a", "omit"), ("tags[0]", "b", "omit"), ("tags[-1]", "c", "omit"), ("tags[9]", "d", "omit"), ("tags[]", "e", "omit"), ("loc.city", "f", "omit"), ("loc.code", "g", "omit"), ("items[].k", "h", "omit"), ("items[].n", "i", "omit"), ("items[1].k", "j", "omit"), ("no.such", "k", "omit"), ("name[0]", "l", "omit"), ("name.x", "m", "omit"), ("items[].n[0]", "n", "omit"))
    assert got[0] == {"a": "ann", "b": "x", "c": "z", "e": ["x", None, "z"], "f": "Rome", "g": None, "h": ["a", "c"], "i": [[1, 2], []], "j": None, "n": [1]}
    # A null leaf is present, a null parent or array is not.
    assert got[1] == {"a": None, "e": []}


def test_whole_record_and_key_order(df):
    assert split_path(".") == []
    got = project_json(df, {"fields": [{"from": ".", "path": "all", "on_missing": "null"}, {"from": "id", "path": "z", "on_missing": "null"}, {"from": "id", "path": "a", "on_missing": "null"}]}).first().json
    assert list(json.loads(got)) == ["all", "z", "a"] and json.loads(got)["all"]["loc"] == {"city": "Rome", "code": None}


def test_policies(df):
    assert project(df, ("tags[0]", "b", "null"), ("gone", "c.d", "null")) == [{"b": "x", "c": {"d": None}}, {"b": None, "c": {"d": None}}]
    assert project(df, ("tags[0]", "b.c", "omit")) == [{"b": {"c": "x"}}, {}]
    assert project(df.filter("id = 1"), ("tags[0]", "b", "error")) == [{"b": "x"}]
    for field in (("tags[0]", "b", "error"), ("gone", "b", "error"), ("loc.city", "b", "error"), ("items[]", "b", "error")):
        with pytest.raises(PySparkException, match="is missing"):
            project(df, field)


def test_formats(df):
    assert project(df, ("tags", "a", "null", "join_comma"), ("tags", "b", "null", "count"), ("name", "c", "null", "titlecase"), ("items", "d", "null", "count")) == [{"a": "x, z", "b": 3, "c": "Ann", "d": 3}, {"a": "", "b": 0, "c": None, "d": 0}]
    # An unknown format matters only where its path is present.
    assert project(df.filter("id = 2"), ("tags[0]", "a", "omit", "nope")) == [{}]
    with pytest.raises(PySparkException, match="unknown format"):
        project(df, ("tags[0]", "a", "omit", "nope"))
    with pytest.raises(ValueError, match="scalar"):
        project(df, ("tags", "a", "null", "uppercase"))


def test_writes_of_one_path(df):
    assert project(df, ("id", "a", "null"), ("tags[0]", "a", "omit")) == [{"a": "x"}, {"a": 2}]
    assert project(df, ("id", "a", "null"), ("tags[0]", "a.b", "omit")) == [{"a": {"b": "x"}}, {"a": 2}]
    assert project(df, ("tags[0]", "a.b", "omit"), ("id", "a", "null")) == [{"a": 1}, {"a": 2}]
    assert project(df, ("id", ".", "null")) == [{}, {}]


def test_writes_into_a_whole_object(df):
    assert project(df, ("loc", "a", "null"), ("id", "a.b", "null")) == [{"a": {"city": "Rome", "code": None, "b": 1}}, {"a": {"b": 2}}]
    got = project(df, ("id", "a.city", "null"), ("name", "a.x", "null"), ("loc", "a", "omit"), ("tags[0]", "a.code", "omit"))
    assert got == [{"a": {"city": "Rome", "code": "x"}}, {"a": None}]
    assert project(df, ("loc", "a", "null"), ("id", "a.b", "null"), ("name", "a", "null")) == [{"a": "ann"}, {"a": None}]
    assert project(df, ("loc", "a", "null"), ("tags[0]", "a.city.x", "omit")) == [{"a": {"city": {"x": "x"}, "code": None}}, {"a": None}]
    (first, _) = project_json(df, {"fields": [{"from": ".", "path": "r", "on_missing": "null"}, {"from": "id", "path": "r.loc.zip", "on_missing": "null"}]}).collect()
    assert json.loads(first.json)["r"]["loc"] == {"city": "Rome", "code": None, "zip": 1} and list(json.loads(first.json)["r"])[:2] == ["id", "name"]


def test_flags(df):
    got = project(df, ("id", "overall_confidence", "null"), flags={"include_overall_confidence": True, "include_provenance": 1, "other": True})
    assert got == [{"overall_confidence": 0.5, "provenance": []}, {"overall_confidence": None, "provenance": []}]
    assert project(df, flags=None) == [{}, {}]


@pytest.mark.parametrize("bad", [{"fields": None}, {"fields": ["x"]}, {"fields": [{"from": " ", "path": "a", "on_missing": "null"}]}, {"fields": [{"from": "a", "path": "a"}]}, {"fields": [{"from": "a", "path": "a", "on_missing": "skip"}]}, {"fields": [{"from": "a", "path": "a", "on_missing": "null", "format": " "}]}])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        Config.parse(bad)


def test_blank_configuration(df):
    assert project_json(df, {}).count() == 2
    with pytest.raises(TypeError):
        Config.parse([])


def test_struct_output(df):
    fields = [{"from": "tags[0]", "path": "a.b", "on_missing": "omit"}, {"from": "id", "path": "c", "on_missing": "null"}]
    rows = project_struct(df, {"fields": fields}, keep=["id"]).orderBy("id").collect()
    assert [(r.a.b, r.c, r._omitted) for r in rows] == [("x", 1, []), (None, 2, ["a.b"])]


def test_scans_are_pruned(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "t"))
    out = project_json(spark.read.parquet(str(tmp_path / "t")), {"fields": [{"from": "loc.city", "path": "c", "on_missing": "null"}]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<loc:struct<city:string>>" in plan
