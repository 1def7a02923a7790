"""Text and date functions, header alignment, page stitching and validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.functions import dates as dt
from sojourn.functions import text as tx
from sojourn.operators import quality as qu
from sojourn.plans.imports import clean_batch
from sojourn.schema import STAY_SCHEMA
from sojourn.sources.headers import align_headers, align_schema
from sojourn.sources.paged import stitch_pages
from workload.tables import AS_OF, AS_OF_SQL, customers, raw, table

KNOWN = [f"NATION_{i}" for i in range(25) if i != 7]


def text_functions(spark, sf):
    """Whole document texts. The sharp s is spelled out first: engines differ on its upper case."""
    c, plain = F.col("text"), F.col("plain")
    rows = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("ß"), F.lit("ss")).alias("text"))
    return rows.withColumn("plain", tx.plain_form(c)).select(
        "doc_id",
        tx.norm_key(c).alias("norm_key"),
        tx.search_of(plain).alias("search_form"),
        tx.slug_of(plain).alias("slug"),
        tx.clean_csv(c).alias("clean_csv"),
        tx.one_line(c).alias("one_line"),
        tx.truncate(c, 80).alias("short"),
        tx.digits_only(c).alias("digits"),
        tx.mask(c, 6).alias("masked"),
        F.array_join(tx.split_keys(c), "|").alias("keys"),
    )


def strip_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.strip_accents(F.col("text")).alias("plain"))


def hash_keys(spark, sf):
    props = F.when(F.col("event_type") != "error", F.col("props"))
    return table(spark, sf, "events").select("event_id", tx.sha256(props).alias("digest"), tx.digits_only(props).alias("digits"))


def key_predicates(spark, sf):
    """Customer keys and typed dates, good and bad."""
    key = F.when(F.col("c_custkey") % 3 == 0, F.replace("c_name", F.lit("#"), F.lit(" . "))).otherwise(F.col("c_name"))
    typed = F.concat(F.col("c_custkey") % 40, F.lit("/"), F.col("c_custkey") % 14, F.lit("/2001"))
    return customers(spark, sf).select(
        "c_custkey", tx.is_valid_key(key).alias("valid_key"), dt.is_valid_date(typed).alias("valid_date")
    )


def typed_dates(spark, sf):
    """Ship dates typed in nine ways, the last of them unusable."""
    day = F.col("l_shipdate").cast("date")
    patterns = ["dd/MM/yyyy", "d-M-yyyy", "yyyy-MM-dd", "yyyy/M/d", " d.M.yyyy", "M/d/yyyy", "d/M/yy", "yyyy-MM-dd HH:mm:ss"]
    typed = F.lit(None).cast("string")
    for way, pattern in enumerate(patterns):
        source = F.col("l_shipdate") if "HH" in pattern else day
        typed = F.when(F.col("l_orderkey") % 9 == way, F.date_format(source, pattern)).otherwise(typed)
    typed = F.when(F.col("l_orderkey") % 9 == 8, F.concat(F.lit("soon "), day.cast("string"))).otherwise(typed)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", day.alias("day"), typed.alias("typed"))


def parse_dates(spark, sf):
    rows = typed_dates(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", F.col("typed").alias("parsed"))
    return dt.parse_dates(rows, ["parsed"])


def date_functions(spark, sf):
    day, typed = F.col("day"), F.col("typed")
    return typed_dates(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        dt.format_date(day).alias("shown"),
        dt.days_between(day, dt.as_date(AS_OF)).alias("days_ago"),
        dt.year_age(day, AS_OF).alias("years"),
        (dt.reformat_date(typed) == typed).alias("unchanged"),
        (dt.lenient_date_text(typed) == "").alias("blank"),
    )


def messy_headers(spark, sf):
    odd = F.col("c_custkey") % 2 == 1
    return customers(spark, sf).select(
        F.when(odd, F.col("c_name")).alias("Số Hộ Chiếu"),
        F.col("c_mktsegment").alias("  HỌ VÀ TÊN "),
        F.col("c_name").alias("Passport"),
        F.col("n_name").alias("QT"),
        F.col("c_acctbal").alias("balance"),
    )


def align_to_schema(spark, sf):
    rows = customers(spark, sf).select(
        F.col("c_name").alias("subject"), F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 9000).cast("int")), "d.M.yyyy").alias("birth_date"),
        F.col("n_name").alias("category"), F.col("c_acctbal").alias("ignored"), F.col("c_custkey").alias("position"),
    )
    wanted = T.StructType([f for f in STAY_SCHEMA.fields if f.name not in ("updated_at", "source_file")])
    return align_schema(rows, wanted, ["subject"], ["position"])


def paged_cells(spark, sf):
    """Orders as pages of 40 rows in five files. Page 1 has a header, every third page repeats it with
    the columns in another order, some row numbers are no numbers."""
    at = F.floor(F.col("o_orderkey") / 5)
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("file"), F.col("o_orderkey") % 5).alias("file"),
        (F.floor(at / 40) + 1).alias("page"),
        (at % 40 + 2).alias("row_no"),
        F.when(F.col("o_orderkey") % 11 == 0, "carried").otherwise(F.col("o_orderkey").cast("string")).alias("n"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("c"), F.col("o_orderstatus").alias("s"),
    )
    swapped = F.col("page") % 3 == 0
    cells = F.when(swapped, F.array("n", "s", "c")).otherwise(F.array("n", "c", "s"))
    header = F.when(swapped, F.array(F.lit("stt"), F.lit("State"), F.lit("Who"))).otherwise(
        F.array(F.lit("STT"), F.lit("Who"), F.lit("State"))
    )
    headed = rows.select("file", "page").distinct().filter((F.col("page") == 1) | swapped)
    body = rows.select("file", "page", "row_no", cells.alias("cells"))
    return body.unionByName(headed.select("file", "page", F.lit(1).cast("long").alias("row_no"), header.alias("cells")))


def stitch_paged_table(spark, sf):
    return stitch_pages(paged_cells(spark, sf), {"STT": "number", "Who": "subject", "State": "place"})


def cleaned(spark, sf):
    return clean_batch(raw(spark, sf))


def import_clean(spark, sf):
    return cleaned(spark, sf).filter("subject <> ''").select(*[f.name for f in STAY_SCHEMA.fields if f.name != "updated_at"], "position.*")


def validated(spark, sf):
    rows = cleaned(spark, sf).filter("subject <> ''")
    return qu.validate(rows, qu.standard_checks(F.col("position"), AS_OF, KNOWN))


def validate_rows(spark, sf):
    codes = F.array_join(F.transform("issues", lambda i: F.concat(i["column"], F.lit(":"), i["code"], F.lit(":"), i["severity"])), ",")
    return validated(spark, sf).select("position.*", codes.alias("issues"))


def valid_rows(spark, sf):
    valid, _ = qu.split_valid(qu.worked_out(validated(spark, sf)))
    return valid.select("subject", "start_date", "end_date", "category", "position.*")


def quality_sample(spark, sf):
    sample = qu.quality_sample(validated(spark, sf), "position")
    return sample.select("row.*", "is_valid", "errors", "warnings")


QUERIES = {
    "text_functions": text_functions,
    "strip_accents": strip_accents,
    "hash_keys": hash_keys,
    "key_predicates": key_predicates,
    "parse_dates": parse_dates,
    "date_functions": date_functions,
    "align_headers": lambda s, d: align_headers(messy_headers(s, d)),
    "align_schema": align_to_schema,
    "stitch_paged_table": stitch_paged_table,
    "import_clean": import_clean,
    "validate_rows": validate_rows,
    "valid_rows": valid_rows,
    "quality_report": lambda s, d: qu.quality_report(validated(s, d)),
    "quality_sample": quality_sample,
}

_SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\p{Z}"
_SPELLED = [("đ", "d"), ("Đ", "D"), ("ð", "d"), ("Ð", "D"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("ı", "i"),
            ("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th")]


def _plain(column: str) -> str:
    for letter, spelled in _SPELLED:
        column = f"replace({column}, '{letter}', '{spelled}')"
    return f"strip_accents({column})"


def _stripped(column: str) -> str:
    return f"regexp_replace({column}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _key(column: str) -> str:
    return f"regexp_replace(upper({column}), '[{_SPACE}\\-_.]+', '', 'g')"


_TYPED = """t AS (SELECT *, CAST(l_shipdate AS DATE) AS day, l_orderkey % 9 AS way FROM lineitem)"""
_PARSED = """CASE WHEN way = 8 THEN NULL WHEN way = 5 AND day(day) <= 12 THEN make_date(year(day), day(day), month(day))
  ELSE day END"""
_RAW = """raw AS (
  SELECT CASE WHEN c_custkey % 20 = 3 THEN '' WHEN c_custkey % 20 = 4 THEN 'A1' WHEN c_custkey % 20 = 5 THEN upper(c_name)
      ELSE upper(replace(c_name, '#', '')) END AS subject,
    c_name AS name, DATE '1950-01-01' + CAST(c_custkey * 37 % 22000 AS INTEGER) AS birth_date,
    CASE WHEN n_nationkey = 7 THEN 'ELSEWHERE' ELSE n_name END AS category,
    CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) - 3 AS end_date,
    p_name || ', ' || p_brand AS place, CAST(NULL AS VARCHAR) AS verified_label, 'lineitem' AS source_file,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
_CHECKED = f"""checked AS (
  SELECT *, CASE WHEN length(subject) < 5 THEN 'subject:short:error' WHEN contains(subject, '#') THEN 'subject:charset:error' END AS i1,
    CASE WHEN birth_date > {AS_OF_SQL} THEN 'birth_date:future:error' END AS i2,
    CASE WHEN start_date > {AS_OF_SQL} THEN 'start_date:future:error' END AS i3,
    CASE WHEN end_date > {AS_OF_SQL} THEN 'end_date:future:error' END AS i4,
    CASE WHEN end_date < start_date THEN 'end_date:order:error' END AS i5,
    CASE WHEN category = 'ELSEWHERE' THEN 'category:unknown:warning' END AS i6
  FROM raw WHERE subject <> '')"""
_POSITION = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_ERRORS = " + ".join(f"CAST(i{i} IS NOT NULL AS INTEGER)" for i in range(1, 6))

ORACLES = {
    "text_functions": f"""
      WITH d AS (SELECT doc_id, replace(text, 'ß', 'ss') AS t FROM documents)
      SELECT doc_id, {_key('t')} AS norm_key,
        {_stripped(f"regexp_replace(lower({_plain('t')}), '[{_SPACE}]+', ' ', 'g')")} AS search_form,
        regexp_replace(regexp_replace(lower({_plain('t')}), '[{_SPACE}]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS slug,
        {_stripped("replace(regexp_replace(t, '[\\r\\n]+', ' ', 'g'), '\"', '\"\"')")} AS clean_csv,
        replace(t, chr(10), ', ') AS one_line,
        CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS short,
        regexp_replace(t, '[^0-9]', '', 'g') AS digits,
        CASE WHEN length(t) <= 12 THEN repeat('*', length(t)) ELSE substr(t, 1, 6) || repeat('*', length(t) - 12) || substr(t, -6) END AS masked,
        array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[,;\\n\\r\\t]+'), lambda x: {_key('x')}),
          lambda x: length(x) >= 5 AND regexp_full_match(x, '[\\p{{L}}\\p{{N}}]+')), '|') AS keys
      FROM d""",
    "strip_accents": f"SELECT doc_id, {_plain('text')} AS plain FROM documents",
    "hash_keys": """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE sha256(props) END AS digest,
      CASE WHEN event_type <> 'error' THEN regexp_replace(props, '[^0-9]', '', 'g') END AS digits FROM events""",
    "key_predicates": """SELECT c_custkey, c_custkey % 3 = 0 AS valid_key,
      coalesce(try_cast('2001-' || (c_custkey % 14) || '-' || (c_custkey % 40) AS DATE),
        try_cast('2001-' || (c_custkey % 40) || '-' || (c_custkey % 14) AS DATE)) IS NOT NULL AS valid_date FROM customer""",
    "parse_dates": f"WITH {_TYPED} SELECT l_orderkey, l_linenumber, l_partkey, {_PARSED} AS parsed FROM t",
    "date_functions": f"""WITH {_TYPED}
      SELECT l_orderkey, l_linenumber, l_partkey, strftime(day, '%d/%m/%Y') AS shown,
        CAST({AS_OF_SQL} - day AS INTEGER) AS days_ago, CAST(year({AS_OF_SQL}) - year(day) AS INTEGER) AS years,
        way IN (0, 8) OR (way = 5 AND month(day) >= 10 AND day(day) BETWEEN 10 AND 12) AS unchanged, way = 8 AS blank FROM t""",
    "align_headers": """SELECT c_name AS subject, c_mktsegment AS name, n_name AS category, c_acctbal AS balance
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "align_schema": """SELECT c_name AS subject, CAST(NULL AS VARCHAR) AS name,
        DATE '1990-01-01' + CAST(c_custkey % 9000 AS INTEGER) AS birth_date, n_name AS category, CAST(NULL AS DATE) AS start_date,
        CAST(NULL AS DATE) AS end_date, CAST(NULL AS VARCHAR) AS place, CAST(NULL AS VARCHAR) AS verified_label,
        c_custkey AS position
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "stitch_paged_table": """SELECT 'file' || (o_orderkey % 5) AS file, o_orderkey // 5 // 40 + 1 AS page,
        o_orderkey // 5 % 40 + 2 AS row_no, CAST(o_orderkey AS VARCHAR) AS number, 'C' || o_custkey AS subject,
        o_orderstatus AS place FROM orders WHERE o_orderkey % 11 <> 0""",
    "import_clean": f"WITH {_RAW} SELECT * FROM raw WHERE subject <> ''",
    "validate_rows": f"WITH {_RAW}, {_CHECKED} SELECT {_POSITION}, concat_ws(',', i1, i2, i3, i4, i5, i6) AS issues FROM checked",
    "valid_rows": f"""WITH {_RAW}, {_CHECKED} SELECT subject, start_date, end_date, category, {_POSITION}
      FROM checked WHERE {_ERRORS} = 0""",
    "quality_report": f"""WITH {_RAW}, {_CHECKED}
      SELECT split_part(i, ':', 1) AS "column", split_part(i, ':', 2) AS code, split_part(i, ':', 3) AS severity, count(*) AS n
      FROM (SELECT unnest([i1, i2, i3, i4, i5, i6]) AS i FROM checked) WHERE i IS NOT NULL GROUP BY ALL""",
    "quality_sample": f"""WITH {_RAW}, {_CHECKED}
      SELECT {_POSITION}, {_ERRORS} = 0 AS is_valid, {_ERRORS} AS errors, CAST(i6 IS NOT NULL AS INTEGER) AS warnings FROM checked
      WHERE {_ERRORS} > 0 OR i6 IS NOT NULL ORDER BY {_POSITION} LIMIT 100""",
}
