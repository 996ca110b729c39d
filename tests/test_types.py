"""Lexical spaces, facets and regular expressions."""

import re

import pytest
from pyspark.sql import functions as F

from treequill.operators import facets
from treequill.operators.facets import builtin, list_of, union_of
from treequill.types import lexical, regex
from treequill.xpath.errors import XPathError

GOOD = {
    "boolean": ["true", "0", " 1 "], "decimal": ["1", "-.5", "+3.", "0001.50"], "integer": ["-0", "+12"], "byte": ["-128", "127"], "unsignedByte": ["255", "+0"], "unsignedLong": ["18446744073709551615"], "long": ["-9223372036854775808"],
    "positiveInteger": ["1", "99999999999999999999999999999999999999999"], "nonPositiveInteger": ["0", "-5"], "float": ["1e5", "INF", "-INF", "NaN", "+INF", ".5E-3"], "double": ["-0"], "date": ["2024-02-29", "2023-12-31Z", "-0044-03-15+14:00", "12024-01-01"],
    "dateTime": ["2024-01-01T00:00:00", "2024-01-01T24:00:00", "2024-01-01T23:59:59.123456789Z"], "dateTimeStamp": ["2024-01-01T00:00:00Z"], "time": ["00:00:00", "24:00:00", "13:20:30.5-05:00"], "duration": ["P1Y", "-P1Y2M3DT4H5M6.7S", "PT0S"], "yearMonthDuration": ["P1Y2M"],
    "dayTimeDuration": ["P1DT2H"], "gYear": ["2024", "-0001Z"], "gYearMonth": ["2024-02"], "gMonthDay": ["--02-29"], "gDay": ["---31"], "gMonth": ["--12"], "hexBinary": ["", "0aFF"], "base64Binary": ["", "QUJD", "QQ==", "Q U J D"], "anyURI": ["http://x/é a", ""], "language": ["en", "de-CH-1996"],
    "NCName": ["a", "_x-1.é"], "Name": [":a"], "NMTOKEN": ["-1.a"], "QName": ["a:b", "c"], "NMTOKENS": [" a  b "], "IDREFS": ["a"], "token": [" any  thing "],
}
BAD = {
    "boolean": ["yes", "TRUE", ""], "decimal": ["1e3", "", ".", "1,0"], "integer": ["1.0", "-"], "byte": ["128", "-129"], "unsignedByte": ["256", "-1"], "unsignedLong": ["18446744073709551616"], "positiveInteger": ["0"], "nonPositiveInteger": ["1"], "float": ["inf", "nan", "e5"], "date": ["2024-2-1", "2023-02-29", "2024-13-01", "24-01-01", "2024-01-01+15:00"],
    "dateTime": ["2024-01-01", "2024-01-01T24:00:01", "2024-01-01 00:00:00"], "dateTimeStamp": ["2024-01-01T00:00:00"], "time": ["25:00:00", "1:00:00"], "duration": ["P", "PT", "P1S", "1Y", "P1YT"], "yearMonthDuration": ["P1D"], "dayTimeDuration": ["P1Y"], "gMonthDay": ["--02-30", "--04-31"], "gDay": ["---32"], "hexBinary": ["0", "0g"], "base64Binary": ["Q", "QQ=", "QR=="],
    "language": ["english_us", ""], "NCName": ["1a", "a:b", ""], "QName": ["a:b:c"], "NMTOKENS": ["", " "], "anyURI": ["%zz"],
}


def test_lexical_spaces(spark):
    rows = [(n, t, True) for n, ts in GOOD.items() for t in ts] + [(n, t, False) for n, ts in BAD.items() for t in ts]
    df = spark.createDataFrame(rows, "name string, text string, want boolean")
    for name in sorted({*GOOD, *BAD}):
        own = df.where(F.col("name") == name)
        wrong = own.withColumn("got", F.expr(lexical.valid("text", name))).where("got is distinct from want").collect()
        assert not wrong, wrong


def test_old_lexical_rules(spark):
    df = spark.createDataFrame([("+INF", "0000-01-01")], "f string, d string")
    assert df.selectExpr(lexical.valid("f", "double", "1.0"), lexical.valid("d", "date", "1.0")).first() == (False, False)
    assert df.selectExpr(lexical.valid("f", "double"), lexical.valid("d", "date")).first() == (True, True)


def codes(spark, kind, texts, version="1.1"):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.selectExpr(facets.code_of("t", kind, version)).collect()]


def test_facets(spark):
    kind = builtin("string").restricted("s", {"pattern": ["[a-c]+", "x"], "maxLength": ["3"]}).restricted("t", {"pattern": [".b.*"], "enumeration": ["ab", "abc", "bb"]})
    assert codes(spark, kind, ["ab", "abcc", "x", "cbb", "zb", None]) == [None, "cvc-maxLength-valid", "cvc-pattern-valid", "cvc-enumeration-valid", "cvc-pattern-valid", None]
    number = builtin("decimal").restricted("n", {"minInclusive": ["0"], "maxExclusive": ["100"], "totalDigits": ["3"], "fractionDigits": ["1"]})
    assert codes(spark, number, ["5", " 5.50 ", "5.55", "-1", "100", "99.9", "x", "000.5"]) == [None, None, "cvc-fractionDigits-valid", "cvc-minInclusive-valid", "cvc-maxExclusive-valid", None, "cvc-datatype-valid", None]
    assert codes(spark, builtin("decimal").restricted("e", {"enumeration": ["1"]}), ["1", "1.0"]) == [None, "cvc-enumeration-valid"]
    assert codes(spark, builtin("double").restricted("e", {"enumeration": ["1"]}), ["1.0", "2"]) == [None, "cvc-enumeration-valid"]
    assert codes(spark, builtin("hexBinary").restricted("h", {"length": ["2"]}), ["0a0b", "0a"]) == [None, "cvc-length-valid"]
    zone = builtin("dateTime").restricted("z", {"explicitTimezone": ["required"], "minInclusive": ["2024-01-01T00:00:00Z"]})
    assert codes(spark, zone, ["2024-01-01T01:00:00+01:00", "2024-01-01T01:00:00", "2023-12-31T23:59:59Z"]) == [None, "cvc-explicitTimezone-valid", "cvc-minInclusive-valid"]


def test_lists_and_unions(spark):
    numbers = list_of("numbers", builtin("int")).restricted("few", {"maxLength": ["2"]})
    assert codes(spark, numbers, ["1 2", " 1 ", "", "1 2 3", "1 x"]) == [None, None, None, "cvc-maxLength-valid", "cvc-datatype-valid"]
    either = union_of("either", (builtin("int"), builtin("boolean"))).restricted("some", {"enumeration": ["5", "true"]})
    assert codes(spark, either, ["5", "true", "6", "x"]) == [None, None, "cvc-enumeration-valid", "cvc-datatype-valid"]
    df = spark.createDataFrame([("1",), ("true",), ("?",)], "t string")
    assert [r[0] for r in df.selectExpr(facets.member_of("t", either)).collect()] == ["int", "boolean", None]


@pytest.mark.parametrize(
    ("kind", "restriction", "code"),
    [("string", {"totalDigits": ["3"]}, "cos-applicable-facets"), ("boolean", {"enumeration": ["true"]}, "cos-applicable-facets"), ("string", {"minLength": ["5"], "maxLength": ["3"]}, "st-props-correct"), ("decimal", {"minInclusive": ["5"], "minExclusive": ["5"]}, "st-props-correct"), ("token", {"whiteSpace": ["preserve"]}, "st-props-correct"), ("string", {"length": ["x"]}, "st-props-correct"), ("string", {"pattern": ["["]}, "cvc-pattern-valid")],
)
def test_bad_facets(kind, restriction, code):
    with pytest.raises(XPathError) as e:
        builtin(kind).restricted("bad", restriction)
    assert e.value.code == code


def test_looser_restrictions():
    base = builtin("int").restricted("a", {"maxInclusive": ["10"]})
    with pytest.raises(XPathError) as e:
        base.restricted("b", {"maxInclusive": ["11"]})
    assert e.value.code == "maxInclusive-valid-restriction"
    with pytest.raises(XPathError):
        list_of("l", list_of("m", builtin("int")))


def test_patterns():
    assert regex.schema_pattern(["a|b", "c"]) == r"^(?:(?:a|b)|(?:c))\z"
    assert regex.schema_pattern(["^a$"]) == r"^(?:(?:\^a\$))\z"
    assert regex.xpath_pattern("[a-z-[aeiou]]") == "[a-z&&[^aeiou]]"
    assert regex.may_be_empty("x*") and not regex.may_be_empty("x+")
    for bad in ("a{2,1}", "(", ")", "a]", "[]", "\\y", "(?:a)", "[a", "{1}x}"):
        with pytest.raises(XPathError):
            regex.schema_pattern([bad])
    assert re.compile(regex.xpath_pattern("a.c", "s").replace(r"\z", r"\Z"))


def test_check_column(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, "abcdef", "x"), (3, None, "x")], "k long, v string, code string")
    short = builtin("string").restricted("short", {"maxLength": ["3"]})
    assert [tuple(r) for r in facets.check_column(df, "v", short, ["k"]).collect()] == [(2, "abcdef", "cvc-maxLength-valid")]
