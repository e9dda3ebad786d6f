import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions.formats import FORMATS


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


PHONES = {"(555) 019-2834": "+15550192834", "+44 20 7946 0958": "+442079460958", "15550192834": "+15550192834", "015550192834": None, "12345": None, "1" * 16: None, " ": None, None: None, "(+44) 20 7946 0958": None, "+0123456": "+0123456", " +1234567\t": "+1234567"}
DATES = {"Oct 2022": "2022-10", "2022 October": "2022-10", "2022/10/01": "2022-10", "2022.10": "2022-10", "Sept. 2021": "2021-09", "2019": "2019-01", "till date": "Present", "2022/13": None, "1899-01": None, "Foo 2020": None, "10/2022": None, "2022/10-99": "2022-10", "": None, None: None, " NOW ": "Present", "May\t2020": "2020-05"}
COUNTRIES = {"United States": "US", "USA": "US", "Deutschland": "DE", "xx": "XX", "Atlantis": None, " ": None, None: None, "españa": "ES", "ß": "SS", " u.k. ": "GB"}


@pytest.mark.parametrize("function,table", [(N.try_phone, PHONES), (N.try_date, DATES), (N.try_country, COUNTRIES)])
def test_vectors(spark, function, table):
    assert apply(spark, function, list(table)) == list(table.values())


def test_every_country(spark):
    names = [(a, c) for c, aliases in N.COUNTRY_ALIASES.items() for a in (*aliases, c.lower())]
    assert len(N.COUNTRY_ALIASES) == 52 and len(names) == 195
    assert apply(spark, N.try_country, [a.title() for a, _ in names]) == [c for _, c in names]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="0123456789 ()-+", max_size=18), max_size=60), st.lists(st.text(alphabet="0129/.- octsepmay", max_size=12), max_size=60))
def test_against_plain_python(spark, phones, dates):
    assert apply(spark, N.try_phone, phones) == [oracle.phone(p) for p in phones]
    assert apply(spark, N.try_date, dates) == [oracle.date(d) for d in dates]


def test_strict_forms_raise(spark):
    assert apply(spark, N.phone, ["(555) 019-2834", None]) == ["+15550192834", None]
    for function in (N.phone, N.date, N.country):
        with pytest.raises(PySparkException, match="cannot normalise"):
            apply(spark, function, ["nonsense!"])


def test_reasons(spark):
    assert apply(spark, N.phone_reject_reason, [None, " ", "abc", "12", "1" * 16, "22345678", "(555) 019-2834"]) == ["blank", "blank", "no digits", "too few digits", "too many digits", "no country code", None]


def test_weights(spark):
    assert apply(spark, N.source_weight, ["ats", "recruiter_notes", "x", None]) == [0.95, 0.75, 0.70, 0.70]


def test_strings(spark):
    assert apply(spark, N.safe_str, [None, "", " \n", " a b "]) == [None, None, None, "a b"]
    assert apply(spark, lambda c: N.clean_list(F.split(c, ",")), ["a, ,b ,", None]) == [["a", "b"], []]
    assert apply(spark, lambda c: N.first_truthy(F.lit(""), c, F.lit("z")), ["  ", None]) == ["  ", "z"]


def test_formats(spark):
    df = spark.createDataFrame([("o'neil mary-jane 3rd", ["a", None, "b"]), (None, None), ("", [])], "s string, l array<string>")

    def out(name, column):
        value, _ = FORMATS[name](F.col(column), df.schema[column].dataType)
        return [r[0] for r in df.select(value).collect()]

    assert out("titlecase", "s") == ["O'Neil Mary-Jane 3Rd", None, ""]
    assert out("uppercase", "s")[:2] == ["O'NEIL MARY-JANE 3RD", None]
    assert out("join_comma", "l") == ["a, b", None, ""] and out("join_newline", "l") == ["a\nb", None, ""]
    assert out("first", "l") == ["a", None, None] and out("first", "s")[0].startswith("o'")
    assert out("count", "l") == [3, 0, 0] and out("count", "s") == [1, 0, 1]
    with pytest.raises(ValueError, match="scalar"):
        FORMATS["uppercase"](F.col("l"), df.schema["l"].dataType)
