"""Scalar functions, each over a whole table. NULLs are put in where the tables have none."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.functions import scalars as S

c, lit = F.col, F.lit

_SEG = "nullif(c_mktsegment, 'BUILDING')"
_BAL = "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END"


def _segment():
    return F.nullif(c("c_mktsegment"), lit("BUILDING"))


def _balance():
    return F.when(c("c_acctbal") >= 0, c("c_acctbal"))


# --- NULL handling and casts ------------------------------------------------------


@query("fn_isnull", f"SELECT c_custkey, coalesce({_SEG}, 'none') AS segment FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.coalesce(_segment(), lit("none")).alias("segment"))


@query(
    "fn_coalesce",
    f"SELECT c_custkey, coalesce({_SEG}, nullif(c_name, 'Customer#000000001'), 'x') AS label FROM customer",
)
def _(t):
    name = F.nullif(c("c_name"), lit("Customer#000000001"))
    return t.customer.select("c_custkey", F.coalesce(_segment(), name, lit("x")).alias("label"))


@query("fn_nullif", "SELECT l_orderkey, l_partkey, nullif(l_discount, 0) AS discount FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", F.nullif(c("l_discount"), lit(0.0)).alias("discount"))


@query(
    "fn_is_null",
    f"""
    SELECT count(*) FILTER (WHERE {_SEG} IS NULL) AS missing,
           count(*) FILTER (WHERE {_SEG} IS NOT NULL) AS present FROM customer
    """,
)
def _(t):
    return t.customer.agg(
        F.count_if(_segment().isNull()).alias("missing"),
        F.count_if(_segment().isNotNull()).alias("present"),
    )


@query(
    "fn_cast",
    """
    SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS qty, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day,
           CAST(CAST(l_extendedprice AS DECIMAL(19,1)) AS DOUBLE) AS price FROM lineitem
    """,
)
def _(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        c("l_quantity").cast("bigint").alias("qty"),
        c("l_shipdate").cast("date").alias("day"),
        c("l_extendedprice").cast("decimal(19,1)").alias("price"),
    )


@query(
    "fn_try_convert",
    """
    SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS BIGINT) AS brand_no,
           TRY_CAST(p_brand AS BIGINT) AS bad FROM part
    """,
)
def _(t):
    return t.part.select(
        "p_partkey",
        F.split_part("p_brand", lit("#"), lit(2)).try_cast("bigint").alias("brand_no"),
        c("p_brand").try_cast("bigint").alias("bad"),
    )


@query(
    "fn_convert_style",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%Y%m%d') AS iso_basic,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS odbc FROM orders
    """,
)
def _(t):
    day = c("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.date_format(day, "MM/dd/yyyy").alias("us"),
        F.date_format(day, "yyyyMMdd").alias("iso_basic"),
        F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("odbc"),
    )


@query(
    "fn_safe_ratio",
    "SELECT l_orderkey, l_partkey, l_tax / nullif(l_discount, 0) AS ratio FROM lineitem",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", S.safe_ratio(c("l_tax"), c("l_discount")).alias("ratio"))


# --- text ---------------------------------------------------------------------------


@query("str_concat", f"SELECT c_custkey, {_SEG} || ' ' || c_name AS label FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.concat(_segment(), lit(" "), "c_name").alias("label"))


@query("str_concat_fn", f"SELECT c_custkey, concat({_SEG}, ' ', c_name) AS label FROM customer")
def _(t):
    return t.customer.select(
        "c_custkey", S.concat_null_as_empty(_segment(), lit(" "), c("c_name")).alias("label")
    )


@query("str_trim", "SELECT p_partkey, trim('  ' || p_name || ' ') AS name FROM part")
def _(t):
    return t.part.select("p_partkey", F.trim(F.concat(lit("  "), "p_name", lit(" "))).alias("name"))


@query("str_substring", "SELECT c_custkey, substring(c_name, 10, 6) AS middle FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.substring("c_name", 10, 6).alias("middle"))


@query("str_left", "SELECT p_partkey, left(p_name, 3) AS head FROM part")
def _(t):
    return t.part.select("p_partkey", F.left("p_name", lit(3)).alias("head"))


@query("str_right", "SELECT p_partkey, right(p_name, 4) AS tail FROM part")
def _(t):
    return t.part.select("p_partkey", F.right("p_name", lit(4)).alias("tail"))


@query("str_len", "SELECT doc_id, length(rtrim(text || '  ', ' ')) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", S.text_length(F.concat("text", lit("  "))).alias("n"))


@query("str_datalength", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.octet_length("text").alias("n"))


@query("str_replace", "SELECT p_partkey, replace(p_brand, '#', '.') AS brand FROM part")
def _(t):
    return t.part.select("p_partkey", F.replace("p_brand", lit("#"), lit(".")).alias("brand"))


@query("str_charindex", "SELECT doc_id, strpos(text, ' the ') AS at FROM documents")
def _(t):
    return t.documents.select("doc_id", F.locate(" the ", "text").alias("at"))


@query(
    "str_patindex",
    """
    SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]')
        THEN length(regexp_extract(text, '^[^0-9]*')) + 1 ELSE 0 END AS at FROM documents
    """,
)
def _(t):
    return t.documents.select("doc_id", S.pattern_position("[0-9]", c("text")).alias("at"))


@query("str_stuff", "SELECT c_custkey, left(c_name, 2) || '***' || substring(c_name, 8) AS masked FROM customer")
def _(t):
    return t.customer.select("c_custkey", S.stuff(c("c_name"), 3, 5, "***").alias("masked"))


@query("str_case", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low FROM part")
def _(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"))


@query("str_reverse", "SELECT p_partkey, reverse(p_name) AS r FROM part")
def _(t):
    return t.part.select("p_partkey", F.reverse("p_name").alias("r"))


@query("str_replicate", "SELECT c_custkey, repeat(c_mktsegment, 2) AS r FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.repeat("c_mktsegment", lit(2)).alias("r"))


@query(
    "str_format_number",
    "SELECT o_orderkey, 'USD ' || format('{:,.2f}', o_totalprice) AS amount FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", S.currency(c("o_totalprice")).alias("amount"))


@query(
    "str_split_rows",
    """
    SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word
    """,
)
def _(t):
    words = t.documents.select(F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


# Accented letters of the test languages and their plain forms.
_ACCENTED, _PLAIN = "àâäéèêëîïôöùûüçñáíóúÀÂÄÉÈÊËÎÏÔÖÙÛÜÇÑÁÍÓÚ", "aaaeeeeiioouuucnaiouAAAEEEEIIOOUUUCNAIOU"


@query("str_strip_accents", f"SELECT doc_id, translate(text, '{_ACCENTED}', '{_PLAIN}') AS plain FROM documents")
def _(t):
    return t.documents.select("doc_id", F.translate("text", _ACCENTED, _PLAIN).alias("plain"))


@query(
    "str_accent_insensitive",
    """
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)
    WHERE strip_accents(word) IN ('fur', 'uber', 'le', 'e', 'eau', 'cion') GROUP BY doc_id
    """,
)
def _(t):
    # the collation compares letters without their accents; case still counts
    words = t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    plain = F.collate("word", "UNICODE_AI")
    return words.where(plain.isin("fur", "uber", "le", "e", "eau", "cion")).groupBy("doc_id").agg(F.count("*").alias("n"))


_FOUND = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[.][A-Za-z0-9_]+"


def _addresses(t):
    found = F.regexp_extract_all("text", lit(f"({_FOUND})"), lit(1))
    return t.documents.select("doc_id", F.explode(found).alias("email"))


_ADDRESSES_SQL = f"SELECT doc_id, unnest(regexp_extract_all(text, '{_FOUND}')) AS email FROM documents"


@query(
    "str_email_valid",
    f"""
    SELECT doc_id, email, CAST(regexp_full_match(email, '[\\w.-]+@[\\w.-]+[.]\\w+') AS BIGINT) AS valid
    FROM ({_ADDRESSES_SQL} UNION ALL SELECT doc_id, source FROM documents)
    """,
)
def _(t):
    candidates = _addresses(t).union(t.documents.select("doc_id", "source"))
    return candidates.withColumn("valid", S.is_email(c("email")))


@query(
    "str_email_parts",
    f"SELECT doc_id, split_part(email, '@', 1) AS user_name, split_part(email, '@', 2) AS domain FROM ({_ADDRESSES_SQL})",
)
def _(t):
    return _addresses(t).select(
        "doc_id", S.email_user(c("email")).alias("user_name"), S.email_domain(c("email")).alias("domain")
    )


@query("str_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


# --- dates --------------------------------------------------------------------------

_LINE_DATES = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def _dated(t):
    return t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select(
        "l_orderkey",
        "l_partkey",
        c("o_orderdate").cast("date").alias("ordered"),
        c("l_shipdate").cast("date").alias("shipped"),
    )


def _diff_query(name: str, unit: str, expression):
    @query(
        name,
        f"""
        SELECT l_orderkey, l_partkey, datediff('{unit}', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d
        FROM {_LINE_DATES}
        """,
    )
    def _(t):
        return _dated(t).select("l_orderkey", "l_partkey", expression().alias("d"))


_diff_query("dt_datediff_day", "day", lambda: F.datediff("shipped", "ordered"))
_diff_query("dt_datediff_month", "month", lambda: S.months_crossed(c("ordered"), c("shipped")))
_diff_query("dt_datediff_year", "year", lambda: S.years_crossed(c("ordered"), c("shipped")))


@query(
    "dt_dateadd",
    """
    SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS VARCHAR) AS d,
           CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS m,
           CAST(CAST(o_orderdate - INTERVAL 2 YEAR AS DATE) AS VARCHAR) AS y,
           strftime(o_orderdate + INTERVAL 30 HOUR, '%Y-%m-%d %H:%M:%S') AS h
    FROM orders
    """,
)
def _(t):
    day = c("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        F.date_add(day, 10).alias("d"),
        F.add_months(day, 1).alias("m"),
        F.add_months(day, -24).alias("y"),
        (c("o_orderdate") + F.make_dt_interval(hours=lit(30))).alias("h"),
    )


@query(
    "dt_parts",
    """
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
           dayofweek(o_orderdate) + 1 AS weekday, monthname(o_orderdate) AS month_name,
           dayname(o_orderdate) AS day_name FROM orders
    """,
)
def _(t):
    day = c("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.year(day).alias("y"),
        F.month(day).alias("m"),
        F.dayofmonth(day).alias("d"),
        F.dayofweek(day).alias("weekday"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "EEEE").alias("day_name"),
    )


@query(
    "dt_eomonth",
    """
    SELECT o_orderkey, CAST(last_day(o_orderdate) AS VARCHAR) AS this_month,
           CAST(last_day(o_orderdate + INTERVAL 1 MONTH) AS VARCHAR) AS next_month FROM orders
    """,
)
def _(t):
    day = c("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        S.end_of_month(day).alias("this_month"),
        S.end_of_month(day, 1).alias("next_month"),
    )


@query(
    "dt_fromparts",
    "SELECT o_orderkey, CAST(make_date(year(o_orderdate), month(o_orderdate), 1) AS VARCHAR) AS first FROM orders",
)
def _(t):
    day = c("o_orderdate")
    return t.orders.select("o_orderkey", F.make_date(F.year(day), F.month(day), lit(1)).alias("first"))


@query(
    "dt_isdate",
    """
    SELECT o_orderkey, CAST(TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) IS NOT NULL AS BIGINT) AS ok FROM orders
    """,
)
def _(t):
    text = F.when(c("o_orderstatus") == "F", c("o_orderpriority")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return t.orders.select("o_orderkey", S.is_date(text).alias("ok"))


@query(
    "dt_now",
    """
    SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS age_days,
           CAST(CAST(o_orderdate AS DATE) < DATE '2001-01-01' AS BIGINT) AS in_the_past FROM orders
    """,
)
def _(t):
    # dates that default to the clock take an ``as_of``
    age = S.age_days(c("o_orderdate"), dt.date(2001, 1, 1))
    return t.orders.select("o_orderkey", age.alias("age_days"), (age > 0).alias("in_the_past"))


@query(
    "dt_timezone",
    """
    SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS offset_time,
           strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS india FROM events
    """,
)
def _(t):
    return t.events.select(
        "event_id",
        F.convert_timezone(lit("UTC"), lit("-05:00"), "ts").alias("offset_time"),
        F.convert_timezone(lit("UTC"), lit("Asia/Kolkata"), "ts").alias("india"),
    )


# --- arithmetic and ids -------------------------------------------------------------


@query(
    "math_abs_arith",
    """
    SELECT c_custkey, abs(c_acctbal) AS magnitude, c_custkey // 7 AS whole, c_custkey / 7 AS exact,
           c_custkey % 7 AS rest FROM customer
    """,
)
def _(t):
    return t.customer.select(
        "c_custkey",
        F.abs("c_acctbal").alias("magnitude"),
        F.expr("c_custkey div 7").alias("whole"),
        (c("c_custkey") / 7).alias("exact"),
        (c("c_custkey") % 7).alias("rest"),
    )


@query(
    "math_decimal_money",
    """
    SELECT l_orderkey, l_partkey,
        CAST(round(CAST(l_extendedprice AS DECIMAL(19,4)) * (1 - CAST(l_discount AS DECIMAL(5,4)))
             * (1 + CAST(l_tax AS DECIMAL(5,4))), 4) AS DOUBLE) AS charge
    FROM lineitem
    """,
)
def _(t):
    price = S.as_money(c("l_extendedprice"))
    charge = price * (1 - c("l_discount").cast("decimal(5,4)")) * (1 + c("l_tax").cast("decimal(5,4)"))
    return t.lineitem.select("l_orderkey", "l_partkey", charge.alias("charge"))


@query("id_uuid", "SELECT c_custkey, 36::BIGINT AS id_length FROM customer")
def _(t):
    # the id itself differs from run to run; its length does not
    return t.customer.select("c_custkey", F.uuid().alias("id")).select(
        "c_custkey", F.length("id").alias("id_length")
    )


# --- CSV lists ------------------------------------------------------------------------

_LIST = """
    SELECT doc_id, source || ', ' || n_chars || ',' || chr(10) || '-' || doc_id || ';+5,,99999999999' AS csv FROM documents
"""


def _split_sql(cleaned: str) -> str:
    return f"""
    SELECT doc_id, item FROM (
        SELECT doc_id, TRY_CAST(tok AS BIGINT) AS item FROM (
            SELECT doc_id, trim(unnest(string_split({cleaned}, ','))) AS tok FROM ({_LIST}))
        WHERE regexp_full_match(tok, '[+-]?[0-9]+'))
    WHERE item BETWEEN -2147483648 AND 2147483647
    """


def _lists(t, extra: bool):
    text = F.concat(
        "source", lit(", "), "n_chars", lit(",\n-"), "doc_id", lit(";+5,,99999999999")
    )
    return t.documents.select(
        "doc_id", F.explode(S.split_csv_int(text, extra_separators=extra)).alias("item")
    )


@query("split_csv_int", _split_sql("translate(csv, chr(10), '')"))
def _(t):
    return _lists(t, False)


@query("split_csv_int_loose", _split_sql("translate(csv, chr(10) || ';', ',,')"))
def _(t):
    return _lists(t, True)


@query(
    "while_tokenizer",
    """
    SELECT doc_id, count(*) AS tokens, count(DISTINCT tok) AS different FROM (
        SELECT doc_id, unnest(string_split(text, ',')) AS tok FROM documents) WHERE trim(tok) <> '' GROUP BY doc_id
    """,
)
def _(t):
    tokens = F.filter(F.split("text", ","), lambda token: F.trim(token) != "")
    return t.documents.select(
        "doc_id", F.size(tokens).alias("tokens"), F.size(F.array_distinct(tokens)).alias("different")
    ).where("tokens > 0")
