from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.functions import dates as d
from sojourn.functions import text as t
from tests.conftest import day


def apply(spark, values, *columns, kind="string"):
    indexed = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    picked = indexed.select("i", *[c(F.col("c")).alias(str(n)) for n, c in enumerate(columns)]).orderBy("i")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in picked.collect()]


def test_norm_key(spark):
    values = [" ab-12_3.4 ", "a b c", "a\x1cb", "", None, "x\ty"]
    assert apply(spark, values, t.norm_key) == ["AB1234", "ABC", "AB", "", None, "XY"]


def test_key_forms_differ(spark):
    assert apply(spark, [" ab-1 "], t.view_key, t.norm_key) == [("AB-1", "AB1")]


def test_valid_key(spark):
    values = ["AB123", "a-b 1.2_3", "AB12", "AB#123", "", None, "Đ1234"]
    assert apply(spark, values, t.is_valid_key) == [True, True, False, False, False, False, True]


def test_split_keys(spark):
    values = ["ab123, cd 456;ef\n12345\tno!!!!", "", None]
    assert apply(spark, values, t.split_keys) == [["AB123", "CD456", "12345"], [], []]


def test_accents(spark):
    values = ["Đặng Thị Ươ", "façade ÆØß", "é", None]
    assert apply(spark, values, t.strip_accents) == ["Dang Thi Uo", "facade AEOss", "e", None]
    assert apply(spark, ["  Ngày   Đến X "], t.search_form, t.slug) == [("ngay den x", "_ngay_den_x_")]
    assert [t.header_slug(h) for h in ("Ngày đến", "Số hộ chiếu", "a (b)!")] == ["ngay_den", "so_ho_chieu", "a_b"]


def test_csv_truncate_mask_hash(spark):
    assert apply(spark, [' a\r\n"b" '], t.clean_csv) == ['a ""b""']
    assert apply(spark, ["abcdef", "abc", None], lambda c: t.truncate(c, 5)) == ["ab...", "abc", ""]
    assert apply(spark, ["abcdefghij", "abcdefgh", "ab", "", None], t.mask) == ["abcd**ghij", "********", "**", "", ""]
    assert apply(spark, ["a1b22", None], t.digits_only) == ["122", None]
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert apply(spark, ["abc", "", None], t.sha256) == [digest, "", ""]
    assert apply(spark, ["a\nb"], t.one_line) == ["a, b"]


def test_contains_any_is_literal(spark):
    assert apply(spark, ["50% Off", "50 off", None], lambda c: t.contains_any(c, ["50%"])) == [True, False, False]


DATES = {
    "31/12/2020": "2020-12-31", "1/2/2020": "2020-02-01", "31-12-2020": "2020-12-31", "2020-12-31": "2020-12-31",
    "2020/1/2": "2020-01-02", "31.12.2020": "2020-12-31", "12/31/2020": "2020-12-31", "05/06/49": "2049-06-05",
    "05/06/50": "1950-06-05", "12-31-2020": "2020-12-31", " 1/2/2020 ": "2020-02-01", "1/2/2020 10:30": "2020-02-01",
    "2020-12-31 00:00:00": "2020-12-31", "2020-12-31T10:00": "2020-12-31", "1/2/20205": "2020-02-01", "29/02/2020": "2020-02-29",
    "29/02/2021": None, "31/04/2020": None, "32/13/2020": None, "0/1/2020": None, "2020-12/31": None, "2020.12.31": None,
    "20201231": None, "soon": None, "": None, "1/2": None, "001/2/2020": None, "1/2/203": "0203-02-01", "2020-13-01": None,
}


def test_parse_date(spark):
    texts = [*DATES, None]
    expected = [*[day(v) for v in DATES.values()], None]
    assert apply(spark, texts, d.parse_date) == expected
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    assert [r.c for r in d.parse_dates(frame, ["c"]).orderBy("i").collect()] == expected


def test_date_texts(spark):
    values = ["2020-12-31", "soon"]
    assert apply(spark, values, d.reformat_date, d.lenient_date_text, d.is_valid_date) == [
        ("31/12/2020", "31/12/2020", True), ("soon", "", False),
    ]


def test_days_and_ages(spark):
    row = spark.sql("select date'2020-01-01' a, date'2020-01-31' b, cast(null as date) n, date'2002-12-31' born").select(
        d.days_between(F.col("a"), F.col("b")), d.days_between(F.col("b"), F.col("a")), d.days_between(F.col("n"), F.col("b")),
        d.year_age(F.col("born"), "2020-01-01"),
    ).first()
    assert tuple(row) == (30, -30, 0, 18)  # 18 by year, though the birthday is months away


def test_dates_take_one_pattern_a_column(spark):
    """Shape and numbers of a date come from one pass of a pattern; a second one tells whether the text needs trimming."""
    frame = spark.range(2).selectExpr("cast(date'2001-02-03' + cast(id as int) as string) as c")
    plan = d.parse_dates(frame, ["c"])._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(name) for name in ("RLIKE", "regexp_extract(", "regexp_replace(")) == 2
    texts = ["2001-02-03\n", "2001/02-03", "2001.02.03", "31/04/2001", "29.2.2000 x", "2001-13-01", "13/13/2001", "1-2-99", "1-2-049", "  4/5/2001T", "2001-02-03x", "0001-1-1", "0/1/2001", ""]
    want = ["2001-02-03", None, None, None, "2000-02-29", None, None, "1999-02-01", "2049-02-01", "2001-05-04", None, "0001-01-01", None, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = [r.c.isoformat() if r.c else None for r in d.parse_dates(frame, ["c"]).orderBy("i").collect()]
    assert got == want
