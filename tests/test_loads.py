"""Validation, import, upsert, files, paged tables and the drop folder."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.operators import quality as qu
from sojourn.operators import upsert as up
from sojourn.plans.imports import clean_batch, clean_lookup, import_labels, import_rows
from sojourn.schema import STAY_SCHEMA
from sojourn.sources import files, tables, versions
from sojourn.sources.headers import align_headers, align_schema, canonical_name
from sojourn.sources.paged import stitch_pages
from sojourn.streaming.ingest import ingest_folder
from tests.conftest import day, rows

AS_OF = "2025-06-30"
NOW = dt.datetime(2025, 7, 1, 12)


def typed(spark, *cells, columns="so_ho_chieu, ho_ten, ngay_den, ngay_di"):
    names = [c.strip() for c in columns.split(",")]
    schema = ", ".join(f"`{n}` string" for n in names)
    padded = [(*row, *[None] * (len(names) - len(row)), i) for i, row in enumerate(cells)]
    return spark.createDataFrame(padded, f"{schema}, position int")


def test_the_five_documented_rows(spark, make_stays):
    raw = typed(
        spark,
        ("ABC12345", "Valid Person", "2025-01-01", "2025-02-01"),
        ("", "Empty key", "2025-01-01"),
        ("XYZ", "Short key", "2025-01-01"),
        ("FUTURE123", "Future date", "2099-01-01"),
        ("VALID999", "Another valid", "2025-01-01"),
    )
    result = import_rows(make_stays().filter("false"), raw, NOW, AS_OF, [])
    assert result.summary.first().asDict() == {
        "imported": 2, "inserted": 2, "updated": 0, "skipped": 3, "errors": 2, "warnings": 0,
    }
    assert rows(result.table, "subject", "action") == [("ABC12345", "inserted"), ("VALID999", "inserted")]
    assert rows(qu.quality_report(result.validated)) == [("start_date", "future", "error", 1), ("subject", "short", "error", 1)]


def test_checks(spark):
    df = spark.createDataFrame(
        [
            (1, None, None, None, None, None), (2, "a-1 2", None, None, None, None), (3, "AB#1234", None, None, None, "Nowhere"),
            (4, "ABC123", "2030-01-01", "2030-01-01", "2029-01-01", " lao "), (5, "ABC123", "2025-06-30", "2025-06-30", None, " "),
        ],
        "row int, subject string, birth_date string, start_date string, end_date string, category string",
    )
    df = df.withColumns({c: F.col(c).cast("date") for c in ("birth_date", "start_date", "end_date")})
    checked = qu.validate(df, qu.standard_checks(F.col("row"), AS_OF, ["LAO"]))
    codes = F.transform("issues", lambda i: F.concat(i["column"], F.lit(":"), i["code"]))
    assert rows(checked.select("row", codes.alias("c"))) == [
        (1, ["subject:empty"]), (2, ["subject:short"]), (3, ["subject:charset", "category:unknown"]),
        (4, ["birth_date:future", "start_date:future", "end_date:future", "end_date:order"]), (5, []),
    ]
    valid, rejected = qu.split_valid(checked)
    assert rows(valid, "row") == [(5,)] and rejected.count() + valid.count() == df.count()
    sample = qu.quality_sample(checked, "row", limit=3)
    assert rows(sample, "row", "is_valid", "errors", "warnings") == [(1, False, 1, 0), (2, False, 1, 0), (3, False, 1, 1)]
    strict = qu.validate(df, [qu.not_future(F.col("row"), "start_date", AS_OF, allow_today=False)])
    assert rows(strict.filter(F.size("issues") > 0), "row") == [(4,), (5,)]


def batch_of(spark, *cells):
    """(subject, start, name, label, position)"""
    schema = "subject string, start string, name string, verified_label string, position int"
    df = spark.createDataFrame(cells, schema).withColumn("start_date", F.col("start").cast("date")).drop("start")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("birth_date", "date"), ("category", "string"), ("end_date", "date"), ("place", "string"), ("source_file", "string"))]
    return df.select("*", *empty)


@pytest.fixture(scope="module")
def upsert_case(spark, make_stays):
    current = make_stays(
        {"subject": "A", "start": "2025-01-01", "label": "KEEP"}, {"subject": "A", "start": "2025-02-01", "label": "OLD"},
        {"subject": "A", "start": "2025-02-01", "label": "TWIN"}, {"subject": "B", "start": "2025-01-01"}, {"subject": "C", "start": None},
    )
    batch = batch_of(
        spark, ("A", "2025-01-01", "new", "", 1), ("A", "2025-02-01", "first", "X", 2), ("A", "2025-02-01", "last", "Y", 3),
        ("C", None, "undated", None, 4), ("D", "2025-01-01", "added", "Z", 5),
    )
    return current, batch


def test_upsert(upsert_case):
    current, batch = upsert_case
    tagged = up.upsert_tagged(current, batch, NOW, "position")
    assert rows(tagged, "subject", "start_date", "name", "verified_label", "action") == [
        ("A", day("2025-01-01"), "new", "KEEP", "updated"), ("A", day("2025-02-01"), "last", "Y", "updated"),
        ("A", day("2025-02-01"), "last", "Y", "updated"), ("B", day("2025-01-01"), "N", None, "kept"),
        ("C", None, "N", None, "kept"), ("C", None, "undated", None, "inserted"), ("D", day("2025-01-01"), "added", "Z", "inserted"),
    ]
    assert {r.updated_at for r in tagged.filter("action <> 'kept'").collect()} == {NOW}
    assert tagged.filter("action = 'kept'").filter(F.year("updated_at") == 2025).isEmpty()


def test_load_time_does_not_shift_with_the_time_zone(spark, upsert_case):
    current, batch = upsert_case
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        tagged = up.upsert_tagged(current, batch, NOW, "position").filter("action <> 'kept'")
        assert {r.updated_at for r in tagged.collect()} == {NOW}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_upsert_twice_adds_only_undated_rows(upsert_case):
    current, batch = upsert_case
    once = up.upsert(current, batch, NOW, "position")
    again = up.upsert_tagged(once, batch, NOW, "position")
    assert rows(up.action_counts(again)) == [(1, 4)]
    safe = up.upsert(current, batch, NOW, "position", null_safe=True)
    assert rows(up.action_counts(up.upsert_tagged(safe, batch, NOW, "position", null_safe=True))) == [(0, 5)]
    assert rows(up.upsert(safe, batch, NOW, "position", null_safe=True)) == rows(safe)


def test_matched_and_new_rows(upsert_case):
    current, batch = upsert_case
    assert rows(up.matched_rows(current, batch), "verified_label") == [("KEEP",), ("OLD",), ("TWIN",)]
    latest = up.last_per_key(batch, up.KEYS, "position")
    assert rows(up.new_rows(current, latest), "name") == [("added",), ("undated",)]


def test_labels(spark, make_stays):
    current = make_stays({"subject": "AB1", "start": "2025-01-01", "label": "x"}, {"subject": "AB1", "start": None}, {"subject": "CD2", "label": "y"})
    raw = typed(spark, ("ab-1", "first"), ("AB 1", " second "), ("AB1", " "), ("CD2", None), ("none", "z"), ("", "q"), columns="Số hộ chiếu, Kết quả")
    found = import_labels(current, raw, NOW)
    assert rows(found, "subject", "verified_label") == [("AB1", "second"), ("AB1", "second"), ("CD2", "y")]
    assert found.filter(F.col("updated_at") == F.lit(NOW).cast("timestamp_ntz")).count() == 2
    with pytest.raises(ValueError):
        import_labels(current, raw.drop("Kết quả"), NOW)


def test_lookup_file(spark):
    raw = typed(spark, (" ab-1", " one "), ("nan", "two"), (None, "three"), ("", "four"), columns="So Ho Chieu, Vị trí")
    found = clean_lookup(raw, ["subject", "vi_tri", "site"], "subject", {"so_ho_chieu": "subject"})
    assert rows(found, "subject", "vi_tri", "site") == [("AB1", "one", None)]


def test_headers(spark):
    assert canonical_name(" Ngày Đến ", {"ngày đến": "start_date"}) == "start_date"
    assert canonical_name("NGAY DEN", {"ngày đến": "start_date"}) == "start_date"
    assert canonical_name("qt", {"QT": "special"}, {"qt": "general"}) == "special"
    assert canonical_name("Other", {"qt": "x"}) == "Other"
    df = spark.createDataFrame([(None, "k2", "n"), ("k1", "k3", "m")], "passport string, `Số hộ chiếu` string, `họ tên` string")
    assert rows(align_headers(df), "subject", "name") == [("k1", "m"), ("k2", "n")]  # left before right
    wanted = T.StructType([f for f in STAY_SCHEMA.fields if f.name in ("subject", "start_date", "place")])
    typed_rows = align_schema(spark.createDataFrame([("a", "1/2/2025", 1)], "subject string, start_date string, extra int"), wanted, ["subject"])
    assert rows(typed_rows) == [("a", day("2025-02-01"), None)] and typed_rows.schema == wanted
    with pytest.raises(ValueError):
        align_schema(df, wanted, ["start_date"])


def test_clean_batch(spark):
    raw = typed(spark, (" ab 1.2 ", "  N ", "lao ", "31/12/2024", "x\ny "), columns="Passport, Họ và tên, Quốc tịch, Ngày đến, Địa chỉ")
    got = rows(clean_batch(raw), "subject", "name", "category", "start_date", "end_date", "place")
    assert got == [("AB12", "N", "LAO", day("2024-12-31"), None, "x, y")]


def test_encodings(spark, tmp_path):
    text = "key,name\nA1,é€ù\nA2,plain\nNA,\n"
    for name, encoding in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "cp1252"), ("d", "utf-16")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    (tmp_path / "e.csv").write_bytes("name,key,other\nl\x81,A3,o\n".encode("latin1"))
    path = str(tmp_path)
    found = files.detect_encodings(spark, path, [*files.EXPORT_ENCODINGS, "latin1"])
    assert [e for _, e in sorted((r.path, r.encoding) for r in found.collect())][:4] == ["utf-8-sig", "utf-8-sig", "cp1252", "utf-16"]
    got = files.read_csv(spark, path, ["utf-8", "cp1252", "latin1", "utf-16"])
    assert set(got.columns) == {"key", "name", "other", "source_file", "position"}
    expected = [(k, n, None, f"{f}.csv") for f in "abcd" for k, n in (("A1", "é€ù"), ("A2", "plain"), (None, None))]
    assert rows(got, "key", "name", "other", "source_file") == sorted([*expected, ("A3", "l\x81", "o", "e.csv")], key=repr)
    in_order = [r.key for r in got.filter("source_file = 'a.csv'").orderBy("position").collect()]
    assert in_order == ["A1", "A2", None]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "e.csv"), ["utf-8", "cp1252"])
    with pytest.raises(ValueError):
        files.detect_encodings(spark, path, ["klingon"])


def test_csv_round_trip_and_split(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}", ' "q", line\nbreak ') for i in range(10)], "k string, v string").coalesce(1)
    files.export_csv(df, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfk,v")
    assert rows(files.read_csv(spark, str(tmp_path / "out"), multi_line=True), "k", "v") == rows(df)
    files.write_split(df, str(tmp_path / "parts"), 4)
    sizes = files.rows_per_file(spark.read.csv(str(tmp_path / "parts"), header=True, multiLine=True))
    assert sorted(r.n for r in sizes.collect()) == [2, 4, 4]


def test_stitching(spark):
    cells = [
        ("f", 1, 1, ["STT", "Who", "Where"]), ("f", 1, 2, ["1", "a", "x"]), ("f", 1, 3, ["total", "b", "x"]),
        ("f", 2, 1, ["stt", "Where", "Who"]), ("f", 2, 2, ["2", "y", "c"]),
        ("f", 3, 1, ["3", "d", "z"]), ("f", 3, 2, [None, "e", "z"]), ("f", 3, 3, [" 4.0 ", "f"]),
        ("g", 1, 1, ["No", "Who"]), ("g", 1, 2, ["n/a", "h"]),
    ]
    df = spark.createDataFrame(cells, "file string, page int, row_no int, cells array<string>")
    got = rows(stitch_pages(df, {"Who": "subject", "Where": "place"}), "file", "page", "subject", "place")
    # File g has no row-number column, so nothing is dropped there.
    assert got == [("f", 1, "a", "x"), ("f", 2, "c", "y"), ("f", 3, "d", "z"), ("f", 3, "f", None), ("g", 1, "h", None)]
    pages = [("k", 1, 0, ["Who", "Where"]), ("k", 1, 1, ["a", "x"]), ("k", 2, 0, ["Where", "Who"]), ("k", 2, 1, ["y", "b"])]
    df = spark.createDataFrame(pages, "file string, page int, row_no int, cells array<string>")
    got = rows(stitch_pages(df, {"Who": "subject", "Where": "place"}, every_page=True), "page", "subject", "place")
    assert got == [(1, "a", "x"), (2, "b", "y")]


def test_stored_table(spark, make_stays, upsert_case, tmp_path):
    current, batch = upsert_case
    path = str(tmp_path / "fact")
    tables.append_stays(current, path)
    untouched = make_stays({"subject": " z ", "start": "2024-05-01"})
    tables.append_stays(untouched, path)
    before = versions.current(spark, path).parts["start_month=2024-05"]
    assert len(before) == 1
    staged = tables.upsert_table(spark, path, batch, NOW, "position")
    assert rows(up.action_counts(staged)) == [(2, 3)]
    wanted = up.upsert(current, batch, NOW, "position").unionByName(untouched.withColumn("subject", F.lit("Z")))
    assert rows(tables.read_stays(spark, path)) == rows(wanted.select(STAY_SCHEMA.names))
    assert versions.current(spark, path).parts["start_month=2024-05"] == before  # month not in the batch


def test_drop_folder(spark, make_stays, tmp_path):
    path = str(tmp_path / "fact")
    tables.append_stays(make_stays({"subject": "AB123", "start": "2025-01-01", "name": "before", "label": "KEEP"}), path)
    (tmp_path / "in").mkdir()
    counts = []

    def drop(name, *lines):
        (tmp_path / "in" / name).write_text("Passport,Họ tên,Ngày đến,Ngày đi\n" + "\n".join(lines), encoding="utf-8")
        query = ingest_folder(
            spark, str(tmp_path / "in"), str(tmp_path / "done"), str(tmp_path / "state"), path,
            ["Passport", "Họ tên", "Ngày đến", "Ngày đi"], lambda: NOW, [],
            report=lambda batch_id, summary, checked: counts.append((batch_id, *summary.first())),
        )
        query.awaitTermination()
        assert query.exception() is None
        return rows(tables.read_stays(spark, path), "subject", "name", "verified_label", "source_file")

    first = drop("one.csv", "ab-123,after,01/01/2025,05/01/2025", "cd456,new,02/01/2025,", "x,short,02/01/2025,")
    assert first == [("AB123", "after", "KEEP", "one.csv"), ("CD456", "new", None, "one.csv")]
    second = drop("two.csv", "CD456,corrected,02/01/2025,03/01/2025")
    assert second == [("AB123", "after", "KEEP", "one.csv"), ("CD456", "corrected", None, "two.csv")]
    assert counts == [(0, 2, 1, 1, 1, 1, 0), (1, 1, 0, 1, 0, 0, 0)]
    assert list((tmp_path / "done").rglob("one.csv"))  # archived once a later run had begun


def test_drop_folder_reads_like_a_batch_import(spark, make_stays, tmp_path):
    """Encodings, column orders, line breaks and awkward names side by side in one drop."""
    path, folder = str(tmp_path / "fact"), tmp_path / "in"
    tables.append_stays(make_stays({"subject": "AB123", "start": "2025-01-01", "name": "before", "label": "KEEP"}), path)
    folder.mkdir()
    (folder / "west.csv").write_bytes("passport,ho ten,ngay den,ngay di,address\nAB123,José 5€,01/01/2025,05/01/2025,Málaga\n".encode("cp1252"))
    (folder / "wide.csv").write_bytes("Ngày đến,Địa chỉ,Passport,Họ tên\n02/01/2025,\"Hà\nNội\",CD456,Đặng\n".encode("utf-16"))
    (folder / "a [1] b%20.csv").write_text("Họ tên,Passport,Ngày đến,Địa chỉ\nÉva,EF789,03/01/2025,\"1st\nfloor, \"\"B\"\"\"\n", encoding="utf-8")
    (folder / "empty.csv").write_bytes(b"")
    query = ingest_folder(
        spark, str(folder), str(tmp_path / "done"), str(tmp_path / "state"), path, ["Passport", "Họ tên", "Ngày đến", "Ngày đi"], lambda: NOW, [],
    )
    query.awaitTermination()
    assert query.exception() is None
    assert rows(tables.read_stays(spark, path), "subject", "name", "place", "verified_label") == [
        ("AB123", "José 5€", "Málaga", "KEEP"), ("CD456", "Đặng", "Hà, Nội", None), ("EF789", "Éva", '1st, floor, "B"', None),
    ]
