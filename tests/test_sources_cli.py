import json

import pytest

from weftline import cli
from weftline.plans import pipeline
from weftline.sources import profiles as S

RECORD = {
    "Full_Name": " Ana Sol ",
    "name": "ignored",
    "email_PRIMARY": "Ana@Sol.example",
    "email": "ana.sol@work.example",
    "phone_RAW": "(555) 010-2030",
    "location": {"city_name": "", "city": "Porto", "cntry": "Portugal"},
    "social_profiles": {"gh": "https://github.com/anasol"},
    "work_history": [{"employer": "Rope Works", "job_title": "Splicer", "date_from": "2017.03", "date_to": "till date"}, {"employer": "No title"}, 5],
    "education_history": [{"school": "Tech", "qualification": "MSc", "end_yr": 2019}, {"school": " "}],
    "skills_list": ["Go", "go", "R", None, True, " "],
    "unread": {"x": 1},
}
NOTES = "Spoke with Ana, ana@sol.example, +1 (555) 010-2030. See https://linkedin.com/in/anasol, and https://blog.example/x."
CONFIG = {
    "fields": [
        {"from": "links.portfolio", "path": "web.pages", "on_missing": "omit"},
        {"from": "links.linkedin", "path": "web.linkedin", "on_missing": "omit"},
        {"from": "emails[1]", "path": "second_mail", "on_missing": "omit"},
        {"from": "experience[-1].start", "path": "since", "on_missing": "null", "format": "yyyy-mm"},
        {"from": "skills[].name", "path": "knows", "on_missing": "null", "format": "join_comma"},
        {"from": "location.country", "path": "land", "on_missing": "null", "format": "iso-alpha2"},
        {"from": "phones[0]", "path": "call", "on_missing": "null", "format": "e164"},
        {"from": "full_name", "path": "who", "on_missing": "error", "format": "uppercase"},
    ],
    "flags": {"include_provenance": True, "include_overall_confidence": True},
}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "ats").mkdir()
    (tmp_path / "ats/a.json").write_text(json.dumps(RECORD))
    (tmp_path / "notes.txt").write_text(NOTES)
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    return tmp_path


def test_json_documents(spark, files):
    good, bad = S.read_json_profiles(spark, str(files / "ats"))
    (p,) = good.collect()
    assert bad.count() == 0
    assert p.full_name == "Ana Sol" and p.emails == ["Ana@Sol.example", "ana.sol@work.example"] and p.phones == ["(555) 010-2030"]
    assert tuple(p.location) == ("Porto", None, "Portugal") and p.links.github == "https://github.com/anasol" and p.links.other == []
    assert [tuple(x) for x in p.experience] == [("Rope Works", "Splicer", "2017.03", "till date", None)]
    assert [tuple(x) for x in p.education] == [("Tech", "MSc", None, None, "2019")]
    assert p.skills == ["Go", "go", "R", "None", "True"]


@pytest.mark.parametrize("text,field,want", [('{"name": "   ", "full_name": ""}', "full_name", None), ('{"full_name": 0, "name": 7}', "full_name", "7"), ('{"full_name": false, "name": true}', "full_name", "True"), ('{"skills_list": [], "skills": " one "}', "skills", ["one"]), ('{"skills": {"a": 1}}', "skills", []), ('{"skills": 3}', "skills", []), ('{"work_history": "text"}', "experience", []), ("{}", "emails", [])])
def test_coercion(spark, text, field, want):
    good, _ = S.map_json_documents(spark.createDataFrame([("x", text)], "_source_id string, value string"))
    assert good.first()[field] == want


@pytest.mark.parametrize("text", ["{", "[1]", '"x"', '{"location": "here"}', '{"social_profiles": [1]}', '{"work_history": 3}', ""])
def test_quarantine(spark, text):
    good, bad = S.map_json_documents(spark.createDataFrame([("x", text), ("y", '{"name": "ok"}')], "_source_id string, value string"))
    assert [r._source_id for r in good.collect()] == ["y"] and [r._source_id for r in bad.collect()] == ["x"] and bad.first().reason


def test_notes_and_extractors(spark, files):
    (p,) = S.read_notes(spark, str(files / "notes.txt")).collect()
    assert p.emails == ["ana@sol.example"] and p.phones == ["+1 (555) 010-2030"]
    assert p.links.linkedin == "https://linkedin.com/in/anasol" and p.links.other == ["https://blog.example/x"] and p.skills == []
    made = {"full_name": " X ", "emails": [" a@b.c ", ""], "phones": None, "location": None, "links": None, "skills": ["s"], "experience": [{"company": "C", "title": None, "start": None, "end": None, "summary": None}], "education": None}
    (p,) = S.read_notes(spark, str(files / "notes.txt"), S.python_extractor(lambda text: made)).collect()
    assert p.full_name == "X" and p.emails == ["a@b.c"] and p.experience == [] and p.location.city is None and p.phones == []


def run(capsys, spark, *argv):
    code = cli.main([str(a) for a in argv], spark)
    out = capsys.readouterr().out
    return code, json.loads(out) if out else None


def test_command_line(capsys, spark, files):
    out = files / "new/out.json"
    code, got = run(capsys, spark, "--ats", files / "ats", "--notes", files / "notes.txt", "--config", files / "config.json", "--out", out, "--pretty")
    assert code == 0 and json.loads(out.read_text()) == got
    log = got.pop("provenance")
    # The portfolio is null, not absent, so it is written in spite of its policy.
    assert list(got) == ["web", "second_mail", "since", "knows", "land", "call", "who", "overall_confidence"]
    assert got == {"web": {"pages": None, "linkedin": "https://linkedin.com/in/anasol"}, "second_mail": "ana.sol@work.example", "since": "2017-03", "knows": "Go, R, None, True", "land": "PT", "call": "+15550102030", "who": "ANA SOL", "overall_confidence": 0.95}
    assert [x["field"] for x in log] == ["full_name", "emails", "emails", "phones", "skills[Go]", "skills[R]", "skills[None]", "skills[True]", "experience[Rope Works|Splicer]", "education[Tech]", "location.city", "location.country", "links.github", "links.linkedin"]
    assert log[-1] == {"field": "links.linkedin", "source": "recruiter_notes", "method": "initial_write", "value": "https://linkedin.com/in/anasol"}


def test_all_candidates_and_bad_files(capsys, spark, files):
    (files / "ats/b.json").write_text("{broken")
    (files / "ats/c.json").write_text('{"name": "other", "email": "o@o.o"}')
    code, got = run(capsys, spark, "--ats", files / "ats", "--notes", files / "none.txt", "--config", files / "config.json", "--all-candidates")
    # The second entity has no experience, which is missing and null; a null country is present.
    assert code == 0 and [x["who"] for x in got] == ["ANA SOL", "OTHER"]


def test_failures(capsys, spark, files):
    assert run(capsys, spark, "--ats", files / "no.json", "--config", files / "config.json") == (1, None)
    assert run(capsys, spark, "--ats", files / "ats", "--config", files / "no.json") == (1, None)
    (files / "config.json").write_text('{"fields": [{"from": "nope", "path": "x", "on_missing": "error"}]}')
    assert run(capsys, spark, "--ats", files / "ats", "--config", files / "config.json") == (1, None)
    with pytest.raises(SystemExit):
        cli.parse_args(["--config", "x"])


def test_write_json(spark, files):
    profiles, _ = pipeline.ingest(spark, str(files / "ats"))
    pipeline.write_json(pipeline.run(profiles, CONFIG), str(files / "sink"))
    assert json.loads(spark.read.text(str(files / "sink")).first().value)["who"] == "ANA SOL"


def test_streaming_upsert(spark, files):
    from weftline.schemas import RAW_PROFILE, struct_of
    from weftline.streaming.upsert import latest_entities, upsert_entities

    profiles, _ = pipeline.ingest(spark, str(files / "ats"), str(files / "notes.txt"))
    profiles.write.parquet(str(files / "in"))
    stream = spark.readStream.schema(struct_of(RAW_PROFILE)).parquet(str(files / "in"))
    query = upsert_entities(stream, str(files / "entities")).option("checkpointLocation", str(files / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert latest_entities(spark, str(files / "entities")).count() == 1
