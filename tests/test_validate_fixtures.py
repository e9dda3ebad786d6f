import json

import pytest
from pyspark.errors import PySparkException

from weftline import cli, fixtures
from weftline.plans.validate import checked, normalised, problems
from weftline.schemas import CANONICAL

GOOD = dict(candidate_id="cand-1", full_name="A", emails=["a@b", "a@b"], phones=[], location=("x", None, " de "), links=None, skills=[(" Go ", 0.5, ["ats"])], experience=[(" C", "T ", "", None, None)], education=[(" U ", None, None, None, None)], overall_confidence=0.95, provenance=[("f", "s", "m", "v")], raw_sources=["r"])


def test_normalised_and_checked(spark):
    df = spark.createDataFrame([GOOD], CANONICAL)
    for r in (normalised(df).first(), checked(df).first()):
        assert r.location.country == "DE" and r.emails == ["a@b"] and r.skills[0].name == "Go" and (r.experience[0].company, r.experience[0].title) == ("C", "T") and r.education[0].institution == "U"
    assert problems(df).count() == 0


def test_problems(spark):
    bad = [GOOD | {"overall_confidence": 1.5}, GOOD | {"candidate_id": None}, GOOD | {"skills": [("x", -0.1, [])]}, GOOD | {"skills": [(None, 0.1, [])]}, GOOD | {"experience": [("c", None, "", None, None)]}, GOOD | {"provenance": [("f", None, "m", "v")]}, GOOD | {"education": [(None,) * 5]}]
    df = spark.createDataFrame(bad, CANONICAL)
    assert problems(df).count() == len(bad)
    for row in bad[:3]:
        with pytest.raises(PySparkException, match="invalid entity"):
            checked(spark.createDataFrame([row], CANONICAL)).collect()


def test_sample_inputs_run_end_to_end(spark, tmp_path, capsys):
    fixtures.main(["--output-dir", str(tmp_path)])
    capsys.readouterr()
    assert cli.main(["--ats", str(tmp_path / "record.json"), "--notes", str(tmp_path / "notes.txt"), "--config", str(tmp_path / "config.json")], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got == {
        "last_school": "DELFT EVENING COLLEGE",
        "career": {"titles": "Foreman\nFitter\nApprentice", "places": 3},
        "mail": ["ilse@boats.example", "crew7@harbour.example"],
        "pages": "https://dorn-boats.example/gallery",
        "home": {"city": "Delft", "region": None, "country": "NL"},
        "person": "Ilse van Dorn",
    }
