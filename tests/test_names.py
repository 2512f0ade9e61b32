"""Name split N1-N8, gender lookup and salutation (FIXTURES.md)."""

from pyspark.sql import functions as F

from leadsmith.functions.names import addressed_name, salutation_safe, split_name, with_split_name
from leadsmith.operators.enrich import enrich_contacts
from leadsmith.operators.outbox import build_outbox, compile_template

CASES = [
    ("Müller, Anna", "Anna", "Müller"),
    ("Dr. Anna-Lena von der Heide", "Anna-Lena", "von der Heide"),
    ("Max Mustermann", "Max", "Mustermann"),
    ("Anna Maria Schmidt", "Anna", "Schmidt"),
    ("Cher", "Cher", None),
    ("Prof. Dr. Jan van den Berg", "Jan", "van den Berg"),
    ("   ", None, None),
    (None, None, None),
]


def test_split_name_fixtures(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, person string")
    staged = {r.i: (r.first_name, r.last_name) for r in with_split_name(df, "person").collect()}
    expr = {r.i: (r.n.first_name, r.n.last_name)
            for r in df.select("i", split_name(F.col("person")).alias("n")).collect()}
    for i, (_, first, last) in enumerate(CASES):
        assert staged[i] == (first, last), CASES[i]
        assert expr[i] == (first, last), CASES[i]


def test_salutation_fixtures(spark):
    df = spark.createDataFrame(
        [("male", "Berg"), ("female", "Heide"), ("mostly_male", "X"), ("unknown", "Y"), (None, "Z"), ("male", None)],
        "gender string, last_name string")
    got = [(r.a, r.n) for r in df.select(salutation_safe("gender", "last_name").alias("a"),
                                         addressed_name("gender", "last_name").alias("n")).collect()]
    neutral = "Sehr geehrte Damen und Herren "
    assert got == [("Lieber Herr ", "Berg"), ("Liebe Frau ", "Heide"), (neutral, ""), (neutral, ""),
                   (neutral, ""), (neutral, "")]


def test_enrich_gender_lookup_case_insensitive(spark):
    dic = spark.createDataFrame([("anna", "female"), ("MAX", "male")], "first_name string, gender string")
    df = spark.createDataFrame([("Anna Berg",), ("Max Koch",), ("Kim Wolf",), (None,)], "person string")
    got = {r.person: (r.gender, r.first_name, r.last_name) for r in enrich_contacts(df, dic).collect()}
    assert got["Anna Berg"] == ("female", "Anna", "Berg")
    assert got["Max Koch"] == ("male", "Max", "Koch")
    assert got["Kim Wolf"] == ("unknown", "Kim", "Wolf")
    assert got[None] == ("unknown", None, None)


def test_outbox_template(spark):
    df = spark.createDataFrame([("a@x.example", "Berg", "male"), ("b@x.example", None, "female")],
                               "email string, last_name string, gender string")
    tpl = "{{ ansprache }} {{ name }},|{{ link_text | default(\"hier\") }}"
    out = {r.email: r.content for r in build_outbox(df, tpl).collect()}
    assert out["a@x.example"] == "Lieber Herr  Berg,|hier"
    assert out["b@x.example"] == "Sehr geehrte Damen und Herren  ,|hier"


def test_template_unknown_placeholder_fails():
    import pytest
    with pytest.raises(KeyError):
        compile_template("{{ nope }}", ["email"])


def test_suffixes(spark):
    cases = [("Max Mustermann, PhD", "Max", "Mustermann"), ("Max Mustermann MBA", "Max", "Mustermann"),
             ("Mustermann, Max Jr.", "Max", "Mustermann"), ("Dr. Max von Berg, Ph.D., MBA", "Max", "von Berg"),
             ("MBA", "MBA", None), ("Maximba Mba-Klein", "Maximba", "Mba-Klein")]
    df = spark.createDataFrame([(c[0],) for c in cases], "person string")
    got = {r.person: (r.first_name, r.last_name) for r in with_split_name(df, "person").collect()}
    assert got == {p: (f, n) for p, f, n in cases}
    whole = with_split_name(df, "person", suffixes=[]).where("person = 'Max Mustermann MBA'").first()
    assert whole.last_name == "MBA"
