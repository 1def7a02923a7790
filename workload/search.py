"""Lookup by text and by key lists, and caller-supplied classification rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.functions.dates import year_age
from sojourn.functions.text import contains_any, not_blank
from sojourn.operators import classify as cl
from sojourn.operators import keywords as kw
from sojourn.operators import reports as rp
from sojourn.operators import search as se
from sojourn.plans import reports as pr
from sojourn.session import materialize
from workload.intervals import profiles
from workload.tables import AS_OF, AS_OF_SQL, PRIORITY, lookups, spellings, sql, stays, table

KEYWORD = "9 urg"


def asked_keys(spark, sf):
    """Keys as a user would paste them: from orders, repeated, plus ones no customer has."""
    orders = table(spark, sf, "orders")
    known = F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    absent = F.concat(F.lit(" No-Such."), F.col("o_orderkey").cast("string"))
    key = F.when(F.col("o_orderstatus") == "F", absent).otherwise(known)
    return orders.select(key.alias("key"), F.col("o_orderkey").alias("pos"))


def search_fuzzy(spark, sf):
    found = se.search_fuzzy(stays(spark, sf), lookups(spark, sf), KEYWORD, AS_OF)
    return found.select("subject", "name", "start_date", "end_date", "status", "days_1y")


def batch(spark, sf, limit=200, offset=100):
    return se.search_batch(stays(spark, sf), lookups(spark, sf), asked_keys(spark, sf), AS_OF, PRIORITY, limit, offset)


def search_batch_all(spark, sf):
    found = se.search_batch_all(stays(spark, sf), lookups(spark, sf), asked_keys(spark, sf), AS_OF, priority=PRIORITY)
    return found.select("subject", "start_date", "status", se.priority_rank(PRIORITY).alias("priority"))


def keys_not_found(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_name").alias("subject"))
    return se.keys_not_found(asked_keys(spark, sf), customers)


def scoring():
    place, status = F.col("place"), F.col("status")
    return cl.Scoring(
        bands=[
            [
                (contains_any(place, ["anvil", "gizmo"]), 3),
                (contains_any(place, ["widget"]), 2),
                (contains_any(place, ["ring", "rod"]), 1),
            ],
            cl.at_least("days_1y", [(90, 3), (30, 2), (8, 1)]),
            cl.at_least("arrivals_1y", [(5, 2), (3, 1)]),
            [(contains_any(status, ["work"]), 2), (contains_any(status, ["family", "review"]), 1)],
        ],
        levels=[(6, "HIGH"), (3, "MEDIUM")],
        lowest="LOW",
        reasons=[
            [(contains_any(place, ["anvil"]), "place anvil"), (contains_any(place, ["widget"]), "place widget")],
            [(F.col("days_1y") >= 30, F.concat(F.lit("stayed "), F.col("days_1y").cast("string"), F.lit(" days")))],
            [(F.col("arrivals_1y") >= 3, F.concat(F.lit("arrived "), F.col("arrivals_1y").cast("string"), F.lit(" times")))],
        ],
        default_reason="several factors",
    )


def rule_score(spark, sf, only_level=None):
    top = cl.rule_score(profiles(spark, sf), scoring(), "subject", 100, only_level)
    return top.select("subject", "score", "level", "reason")


def rule_reasons(spark, sf):
    return profiles(spark, sf).select("subject", cl.reasons(scoring()).alias("reason"))


def stored_profiles(spark, sf):
    """The profile as a stored table, for plans that read it more than once."""
    wanted = ["subject", "birth_date", "category", "start_date", "place", "verified_label", "status", "arrivals_1y", "days_1y"]
    return materialize(profiles(spark, sf).select(*wanted), "profiles")


def flagged(stored):
    return cl.group_flag(stored, ["start_date", "place"], decision().companion, "minor_in_group")


def decision():
    place, decided = F.col("place"), F.col("decision")
    work, family = contains_any(decided, ["work"]), contains_any(decided, ["family", "review"])
    return pr.Decision(
        companion=year_age(F.col("birth_date"), AS_OF) < 18,
        rules=[
            (not_blank(F.col("verified_label")).isNotNull(), F.col("verified_label")),
            (F.col("status") != "", F.col("status")),
            (F.col("minor_in_group") == 1, "FAMILY (presumed)"),
            (contains_any(place, ["anvil", "gizmo"]), "WORK (presumed)"),
            (contains_any(place, ["plate"]), "OTHER"),
            (F.col("days_1y") >= 3, "WORK (presumed)"),
        ],
        default="OTHER",
        classes={"work": work, "travel": F.lit(False), "family": family, "other": ~work & ~family},
        flag="minor_in_group",
    )


def matrix(spark, sf, limit=50):
    asked = pr.ReportFilter(AS_OF, start="1998-01-01")
    needed = ["birth_date", "verified_label", "status", "days_1y"]
    return pr.matrix_report(profiles(spark, sf), asked, decision(), needed, limit)


def matrix_totals(spark, sf):
    return rp.matrix_totals(matrix(spark, sf, None), ["work", "travel", "family", "other"])


def matrix_totals_shown(spark, sf):
    return rp.matrix_totals(matrix(spark, sf, 10), ["work", "travel", "family", "other"])


def keyword_flags(spark, sf):
    """Keyword groups over whole document texts."""
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        contains_any(text, ["license", "copyright"]).alias("legal"),
        contains_any(text, ["password", "secret", "@"]).alias("contact"),
        cl.first_match([(contains_any(text, ["the "]), "en"), (contains_any(text, [" der ", " die "]), "de")], "other").alias("guess"),
    )


def keyword_rules(spark, sf):
    """As many keywords as documents, each a piece of one of them, and for every document the source of the first one it contains."""
    docs = table(spark, sf, "documents")
    rules = docs.select(
        F.substring(F.lower("text"), F.lit(11), F.lit(8) + (F.col("doc_id") % 9).cast("int")).alias("keyword"),
        F.col("doc_id").alias("rank"), F.col("source").alias("value"),
    )
    return kw.first_keyword(docs.select("doc_id", "text"), rules, "doc_id", "text", "none").select("doc_id", "decision", "n_keywords")


QUERIES = {
    "keyword_rules": keyword_rules,
    "search_fuzzy": search_fuzzy,
    "search_batch": lambda s, d: batch(s, d)[0].select("subject", "start_date", "end_date", "status", "days_1y"),
    "search_batch_info": lambda s, d: batch(s, d)[1],
    "search_batch_all": search_batch_all,
    "distinct_keys": lambda s, d: se.distinct_keys(asked_keys(s, d), "key", "pos"),
    "keys_not_found": keys_not_found,
    "category_group": lambda s, d: cl.category_group(profiles(s, d).select("subject", "category"), spellings(s, d)),
    "rule_score": rule_score,
    "rule_score_level": lambda s, d: rule_score(s, d, "MEDIUM"),
    "rule_reasons": rule_reasons,
    "group_flag": lambda s, d: flagged(stored_profiles(s, d)).select("subject", "start_date", "place", "minor_in_group"),
    "rule_cascade": lambda s, d: pr.decide(stored_profiles(s, d), decision()).select("subject", "minor_in_group", "decision"),
    "matrix_report": matrix,
    "matrix_totals": matrix_totals,
    "matrix_totals_shown": matrix_totals_shown,
    "keyword_flags": keyword_flags,
}

_ASKED = """SELECT CASE WHEN o_orderstatus = 'F' THEN 'NOSUCH' || o_orderkey
  ELSE 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS key, min(o_orderkey) AS pos FROM orders GROUP BY 1"""
_BATCH = {"asked": _ASKED, "wanted": "SELECT key FROM asked",
          "found": "FROM prof WHERE subject IN (SELECT key FROM wanted)"}
_RANK = "CASE status WHEN 'ATTENTION' THEN 1 WHEN 'WORK' THEN 2 WHEN 'FAMILY' THEN 3 WHEN 'STUDY' THEN 4 ELSE 5 END"
_SCORED = """SELECT *,
    CASE WHEN place LIKE '%anvil%' OR place LIKE '%gizmo%' THEN 3 WHEN place LIKE '%widget%' THEN 2
      WHEN place LIKE '%ring%' OR place LIKE '%rod%' THEN 1 ELSE 0 END
    + CASE WHEN days_1y >= 90 THEN 3 WHEN days_1y >= 30 THEN 2 WHEN days_1y >= 8 THEN 1 ELSE 0 END
    + CASE WHEN arrivals_1y >= 5 THEN 2 WHEN arrivals_1y >= 3 THEN 1 ELSE 0 END
    + CASE WHEN status = 'WORK' THEN 2 WHEN status IN ('FAMILY', 'REVIEW') THEN 1 ELSE 0 END AS score,
    coalesce(nullif(concat_ws('; ', CASE WHEN place LIKE '%anvil%' THEN 'place anvil' WHEN place LIKE '%widget%' THEN 'place widget' END,
      CASE WHEN days_1y >= 30 THEN 'stayed ' || days_1y || ' days' END,
      CASE WHEN arrivals_1y >= 3 THEN 'arrived ' || arrivals_1y || ' times' END), ''), 'several factors') AS reason
  FROM prof"""
_TOP_SCORES = """SELECT subject, score, CASE WHEN score >= 6 THEN 'HIGH' WHEN score >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS level, reason
  FROM (FROM scored WHERE score > 0 ORDER BY score DESC, subject LIMIT 100)"""
_FLAGGED = f"""SELECT *, max(CASE WHEN year({AS_OF_SQL}) - year(birth_date) < 18 THEN 1 ELSE 0 END)
    OVER (PARTITION BY start_date, place) AS minor_in_group FROM prof"""
_DECIDED = """SELECT *, CASE WHEN nullif(trim(verified_label), '') IS NOT NULL THEN verified_label
    WHEN status IS NOT NULL AND status <> '' THEN status WHEN minor_in_group = 1 THEN 'FAMILY (presumed)'
    WHEN place LIKE '%anvil%' OR place LIKE '%gizmo%' THEN 'WORK (presumed)' WHEN place LIKE '%plate%' THEN 'OTHER'
    WHEN days_1y >= 3 THEN 'WORK (presumed)' ELSE 'OTHER' END AS decision FROM flagged"""
_COUNTED = """SELECT upper(trim(coalesce(category, 'UNKNOWN'))) AS category, count(*) AS n,
    count(*) FILTER (WHERE decision LIKE 'WORK%') AS work, CAST(0 AS BIGINT) AS travel,
    count(*) FILTER (WHERE decision LIKE 'FAMILY%' OR decision = 'REVIEW') AS family,
    count(*) FILTER (WHERE NOT (decision LIKE 'WORK%' OR decision LIKE 'FAMILY%' OR decision = 'REVIEW')) AS other
  FROM decided GROUP BY 1"""
_MATRIX = """SELECT *, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM counted), 2) AS percent FROM counted
  ORDER BY n DESC, category LIMIT {}"""
_TOTALS = """SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(work) AS BIGINT) AS work, CAST(sum(travel) AS BIGINT) AS travel,
  CAST(sum(family) AS BIGINT) AS family, CAST(sum(other) AS BIGINT) AS other, count(*) AS categories FROM shown"""
_CASCADE = {"flagged": _FLAGGED, "decided": _DECIDED}
_SINCE_1998 = {"flagged": f"{_FLAGGED} WHERE start_date >= DATE '1998-01-01'", "decided": _DECIDED}

ORACLES = {
    "search_fuzzy": sql(
        """SELECT subject, name, start_date, end_date, status, days_1y FROM prof
        WHERE contains(replace(subject, ' ', ''), '9URG') OR contains(replace(upper(name), ' ', ''), '9URG')
          OR contains(upper(name), '9 URG') ORDER BY start_date DESC NULLS LAST, subject LIMIT 100""", "prof",
    ),
    "search_batch": sql(
        f"""SELECT subject, start_date, end_date, status, days_1y FROM found
        ORDER BY {_RANK}, start_date DESC NULLS LAST, subject LIMIT 200 OFFSET 100""", "prof", **_BATCH,
    ),
    "search_batch_info": sql(
        """SELECT count(*) AS total, CAST(greatest(least(count(*) - 100, 200), 0) AS BIGINT) AS page_rows,
        count(*) > 300 AS has_more, CAST(100 AS BIGINT) AS "offset", CAST(200 AS BIGINT) AS "limit" FROM found""",
        "prof", **_BATCH,
    ),
    "search_batch_all": sql(f"SELECT subject, start_date, status, {_RANK} AS priority FROM found", "prof", **_BATCH),
    "distinct_keys": f"SELECT key, pos FROM ({_ASKED})",
    "keys_not_found": f"SELECT key FROM ({_ASKED}) WHERE key NOT IN (SELECT upper(c_name) FROM customer)",
    "category_group": sql(
        """SELECT subject, category, coalesce(group_name, 'OTHER') AS group_name FROM prof LEFT JOIN (
          FROM spell QUALIFY row_number() OVER (PARTITION BY spelling ORDER BY group_order) = 1) ON category = spelling""",
        "prof", "spell",
    ),
    "rule_score": sql(_TOP_SCORES, "prof", scored=_SCORED),
    "rule_score_level": sql(_TOP_SCORES.replace("score > 0", "score BETWEEN 3 AND 5"), "prof", scored=_SCORED),
    "rule_reasons": sql("SELECT subject, reason FROM scored", "prof", scored=_SCORED),
    "group_flag": sql("SELECT subject, start_date, place, minor_in_group FROM flagged", "prof", flagged=_FLAGGED),
    "rule_cascade": sql("SELECT subject, minor_in_group, decision FROM decided", "prof", **_CASCADE),
    "matrix_report": sql(_MATRIX.format(50), "prof", **_SINCE_1998, counted=_COUNTED),
    "matrix_totals": sql(_TOTALS, "prof", **_SINCE_1998, counted=_COUNTED, shown="FROM counted"),
    "matrix_totals_shown": sql(_TOTALS, "prof", **_SINCE_1998, counted=_COUNTED, shown=_MATRIX.format(10)),
    "keyword_rules": r"""
      WITH d AS (SELECT doc_id, lower(text) AS t, source FROM documents),
      k AS (
        SELECT substring(t, 11, 8 + CAST(doc_id % 9 AS INT)) AS keyword, min(doc_id) AS rank, arg_min(source, doc_id) AS value
        FROM d GROUP BY 1 HAVING regexp_matches(keyword, '[^ \t\n\x0B\f\r]')),
      hits AS (SELECT doc_id, count(*) AS n, arg_min(value, rank) AS decision FROM d JOIN k ON contains(t, keyword) GROUP BY 1)
      SELECT doc_id, coalesce(decision, 'none') AS decision, coalesce(n, 0) AS n_keywords FROM d LEFT JOIN hits USING (doc_id)""",
    "keyword_flags": """
      WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
      SELECT doc_id, contains(t, 'license') OR contains(t, 'copyright') AS legal,
        contains(t, 'password') OR contains(t, 'secret') OR contains(t, '@') AS contact,
        CASE WHEN contains(t, 'the ') THEN 'en' WHEN contains(t, ' der ') OR contains(t, ' die ') THEN 'de' ELSE 'other' END AS guess
      FROM d""",
}
