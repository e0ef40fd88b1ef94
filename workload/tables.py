"""Snapshots derived from the driver tables, once as DataFrames and once as SQL views.

Each ``X`` function and ``VIEWS["X"]`` describe the same rows. The snapshots have the columns of the
real sources the operators were made for, over whole driver tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans.candidates import Source
from recordloom.sources.contracts import SourceContract
from recordloom.sources.inventory import INVENTORY
from recordloom.sources.snapshot import ROW


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(value: Column) -> Column:
    return F.format_number(value, 2)


def _case(selector: Column, *values: Column) -> Column:
    out = values[-1]
    for i, value in reversed(list(enumerate(values[:-1]))):
        out = F.when(selector == i, value).otherwise(out)
    return out


# --- the two domains ------------------------------------------------------------------------------

PURCHASE_ORDERS = replace(INVENTORY.require("purchase-orders"), code_prefixes=("Brand#1",))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    name = F.col("c_name")
    donor = F.when(F.col("o_orderkey") % 101 == 0, F.concat(name, F.lit(" 12 Main Street"))).otherwise(
        _case(
            F.col("o_orderkey") % 5,
            name,
            F.concat(name, F.lit(" LLC")),
            F.concat(F.lit("  "), F.lower(name), F.lit(", Inc. ")),
            F.concat(name, F.lit(" & Sons, L.L.C.")),
            F.concat(name, F.lit(" Company")),
        )
    )
    kind = (
        F.when(F.col("c_mktsegment") == "MACHINERY", "INDIVIDUAL")
        .when(F.col("o_orderstatus") == "F", " entity ")
        .otherwise("ENTITY")
    )
    amount = F.when(F.col("o_orderkey") % 17 == 0, "n/a").otherwise(
        F.concat(F.lit("$"), money(F.col("o_totalprice")))
    )
    from_orders = orders.select(
        donor.alias("donor"), kind.alias("donor_type"), amount.alias("contribution_amount")
    )
    part = table(spark, sf_dir, "part")
    ending = F.when(F.col("p_partkey") % 3 == 0, " LLC").otherwise("")
    from_parts = part.select(
        F.concat("p_name", ending).alias("donor"),
        F.lit("ENTITY").alias("donor_type"),
        money(F.col("p_retailprice")).alias("contribution_amount"),
    )
    return from_orders.unionByName(from_parts)


def echeckbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    ending = _case(F.col("l_linenumber") % 4, F.lit(""), F.lit(", LLC"), F.lit(" INC"), F.lit(" L.L.P."))
    code = F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit("mis"), F.col("l_suppkey"))).otherwise(
        F.concat(F.lit("V"), F.col("c_nationkey"))
    )
    return lines.select(
        F.concat(F.upper("c_name"), ending).alias("lgl_nm"),
        code.alias("vend_cust_cd"),
        money(F.col("l_extendedprice")).alias("amount"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every seventh record lacks its code cell.
    return table(spark, sf_dir, "customer").select(
        F.concat("c_name", F.lit(" Co.")).alias("lgl_nm"),
        F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("V"), F.col("c_nationkey"))).alias("vend_cust_cd"),
    )


def purchase_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    ending = (
        F.when(F.col("p_partkey") % 5 == 0, ", Inc.").when(F.col("p_partkey") % 5 == 1, ", L.L.C.").otherwise("")
    )
    return lines.select(
        F.concat(F.upper("p_name"), ending).alias("lgl_nm"),
        F.col("p_brand").alias("vendor_code"),
        money(F.col("l_extendedprice")).alias("itm_tot_am"),
    )


def campaign_source(spark: SparkSession, sf_dir: str) -> Source:
    return Source(contributions(spark, sf_dir), INVENTORY.require("campaign-contributions"), "a" * 64)


def public_sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    return [
        Source(echeckbook(spark, sf_dir), INVENTORY.require("echeckbook"), "e" * 64),
        Source(contracts(spark, sf_dir), INVENTORY.require("contracts"), "c" * 64),
        Source(purchase_orders(spark, sf_dir), PURCHASE_ORDERS, "b" * 64),
    ]


# --- profiled snapshots ---------------------------------------------------------------------------

ORDERS = SourceContract(
    "orders", "orders", "Orders",
    {
        "order_id": ("unique",), "customer_id": ("identity",), "status": ("category",), "total": ("amount",),
        "ordered": ("date",), "priority": ("category",), "note": (), "approved": ("date",),
    },
    expected_minimum_rows=10_000,
)
EVENTS = SourceContract(
    "events", "events", "Events",
    {
        "event_id": ("unique",), "ts": ("date",), "user_id": ("identity",), "event_type": ("category",),
        "value": ("amount",), "props": (), "channel": (),
    },
    expected_minimum_rows=1_000,
)
LINEITEM = SourceContract(
    "lineitem", "lineitem", "Lines",
    {
        "l_orderkey": ("unique",), "l_partkey": ("identity",), "l_suppkey": ("identity",), "l_linenumber": (),
        "l_quantity": ("amount", "category"), "l_extendedprice": ("amount",), "l_discount": ("category",),
        "l_tax": (), "l_returnflag": ("category",), "l_linestatus": ("category",), "l_shipdate": ("date",),
    },
    expected_minimum_rows=50_000,
)
DOCUMENTS = SourceContract(
    "documents", "documents", "Documents",
    {"doc_id": ("unique",), "text": ("identity",), "lang": ("category",), "source": ("category",), "n_chars": ("amount",)},
    expected_minimum_rows=200,
)
CONVERSATIONS = SourceContract(
    "conversations", "conversations", "Conversations",
    {"conv_id": ("unique",), "turn": ("category",), "role": ("category",), "text": ("identity",)},
    expected_minimum_rows=1_000_000,
)
AS_OF_YEAR = 2026


def _date_text(at: Column, key: Column) -> Column:
    """A date in one of the spellings exports use; some unreadable, some in impossible years."""
    return _case(
        key % 9,
        F.date_format(at, "MM/dd/yyyy"),
        F.date_format(at, "yyyy-MM-dd"),
        F.concat(F.date_format(at, "MM/dd/yyyy"), F.lit(" 03:04:05 PM")),
        F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T23:30:00-05:00")),
        F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T10:20:30.250Z")),
        F.concat(F.date_format(at, "MM/dd/"), F.lit("0023")),
        F.concat(F.date_format(at, "MM/dd/"), F.lit("2104")),
        F.concat(F.lit("13/45/"), F.date_format(at, "yyyy")),
        F.concat(F.lit("  "), F.date_format(at, "yyyyMMdd"), F.lit(" ")),
    )


def orders_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        (key + 2).alias(ROW),
        F.when(key % 11 == 0, "").otherwise((key - key % 3).cast("string")).alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit(" "), "o_orderstatus").alias("status"),
        F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("$"), money(F.col("o_totalprice")))).alias("total"),
        F.when(key % 13 == 0, "  ").otherwise(_date_text(F.col("o_orderdate"), key)).alias("ordered"),
        F.when(key % 7 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(key % 2 == 0, "").otherwise("x").alias("note"),
        F.lit(" ").alias("approved"),
    )


def events_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 2).alias(ROW),
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        money(F.col("value")).alias("value"),
        "props",
    )


def lineitem_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without record numbers: ties go to the smaller text."""
    def text(name: str) -> Column:
        if name == "l_shipdate":
            return F.date_format(name, "MM/dd/yyyy").alias(name)
        if name in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
            return money(F.col(name)).alias(name)
        return F.col(name).cast("string").alias(name)

    return table(spark, sf_dir, "lineitem").select(*[text(c) for c in LINEITEM.columns])


def documents_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 2).alias(ROW), F.col("doc_id").cast("string").alias("doc_id"), "text", "lang",
        "source", F.col("n_chars").cast("string").alias("n_chars"),
    )


def conversations_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text"
    )


# --- SQL ------------------------------------------------------------------------------------------

# The legal suffixes and the personal-data patterns in the dialect of the SQL engine.
SUFFIX_WORDS = "ASSN|ASSOCIATION|CO|COMPANY|CORP|CORPORATION|INC|INCORPORATED|LC|LLC|LLP|LP|LTD|LIMITED|PA|PC|PLLC"


def sql_strict(expr: str) -> str:
    upper = rf"upper(regexp_replace(strip_accents({expr}), '[^\x00-\x7F]', '', 'g'))"
    dotted = (
        rf"list_reduce(list_prepend({upper}, regexp_extract_all({upper}, '(?:\b[A-Z]\.){{2,}}[A-Z]?\.?')), "
        "lambda a, m: replace(a, m, replace(m, '.', '')))"
    )
    return f"trim(regexp_replace(replace({dotted}, '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'))"


def sql_suffix(strict: str) -> str:
    return f"regexp_replace({strict}, '(?:(?:^| )(?:{SUFFIX_WORDS}))+$', '')"


_W = r"\pL\pN_"
_S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_D = r"\p{Nd}"
SQL_PII = (
    (
        "email",
        rf"(?i)(?:(?:^|[^{_W}])[A-Z0-9_]|[{_W}][.%+-])[A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{{2,}}(?:$|[^{_W}])",
    ),
    (
        "phone",
        rf"(?:^|[^{_D}])(?:\+?1[{_S}./-]*)?(?:\([{_S}]*{_D}{{3}}[{_S}]*\)|{_D}{{3}})[{_S}./-]*{_D}{{3}}"
        rf"[{_S}./-]*{_D}{{4}}(?:$|[^{_D}])",
    ),
    ("ssn", rf"(?:^|[^{_D}]){_D}{{3}}[ -]{_D}{{2}}[ -]{_D}{{4}}(?:$|[^{_D}])"),
    (
        "street_address",
        rf"(?i)(?:^|[^{_W}])P(?:OST(?:AL)?)?\.?[{_S}]*O(?:FFICE)?\.?[{_S}]+BOX[{_S}]+{_D}+"
        rf"(?:[A-Z0-9-]*[A-Z0-9])?(?:$|[^{_W}])",
    ),
    (
        "street_address",
        rf"(?i)(?:^|[^{_W}]){_D}{{1,6}}[{_S}]+(?:[A-Z0-9.''-]+[{_S}]+){{0,5}}(?:ST(?:REET)?|AVE(?:NUE)?|RD|"
        rf"ROAD|BLVD|BOULEVARD|DR|DRIVE|LN|LANE|CT|COURT|WAY|PL|PLACE|PKWY|PARKWAY)(?:$|[^{_W}])",
    ),
)


def sql_pii(expr: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, '{p}')" for _, p in SQL_PII) + ")"


def sql_pii_rows(table_name: str, row: str, columns: tuple[str, ...], exempt: tuple[str, ...] = ()) -> str:
    """One SELECT per column and pattern."""
    parts = []
    for position, column in enumerate(columns):
        for pattern, (kind, regex) in enumerate(SQL_PII):
            if column in exempt and kind in ("phone", "ssn"):
                continue
            parts.append(
                f"SELECT {row} AS row_number, '{column}' AS field, '{kind}' AS kind, '[redacted]' AS preview, "
                f"{position} AS field_position, {pattern} AS pattern_position FROM {table_name} "
                f"WHERE {column} <> '' AND regexp_matches({column}, '{regex}')"
            )
    return " UNION ALL ".join(parts)


def sql_amount(expr: str) -> str:
    return f"coalesce(try_cast(trim(replace(replace({expr}, '$', ''), ',', '')) AS DECIMAL(38,6)), 0)"


def sql_money(expr: str) -> str:
    return "format('{:,.2f}', " + expr + ")"


def sql_case(selector: str, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {selector} {whens} ELSE {values[-1]} END"


def sql_names(source: str, name: str, code: str, amount: str, where: str, relation: str) -> str:
    strict = "strict_key"
    return f"""
      SELECT '{source}' AS source, strict_key, {sql_suffix(strict)} AS suffix_key, code, name, rows, amount
      FROM (SELECT *, {sql_strict("name")} AS strict_key FROM (
        SELECT trim({name}) AS name, {code} AS code, count(*) AS rows, sum({amount}) AS amount
        FROM {relation} WHERE {where} GROUP BY ALL) AS n
        WHERE name <> '' AND NOT {sql_pii("name")}) AS k
      WHERE strict_key <> ''"""


_ENTITY = """
  SELECT source, strict_key, suffix_key, code, sum(rows) AS rows, sum(amount) AS amount,
    first(name ORDER BY rows DESC, lower(name), name) AS display_name,
    string_agg(name, ' | ' ORDER BY name) AS names, list(name ORDER BY name) AS name_list,
    count(DISTINCT name) AS spellings, min(name) AS first_name, max(name) AS last_name
  FROM {names} GROUP BY source, strict_key, suffix_key, code"""

_DATE_SPELLINGS = sql_case(
    "o_orderkey % 9",
    "strftime(o_orderdate, '%m/%d/%Y')",
    "strftime(o_orderdate, '%Y-%m-%d')",
    "strftime(o_orderdate, '%m/%d/%Y') || ' 03:04:05 PM'",
    "strftime(o_orderdate, '%Y-%m-%d') || 'T23:30:00-05:00'",
    "strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30.250Z'",
    "strftime(o_orderdate, '%m/%d/') || '0023'",
    "strftime(o_orderdate, '%m/%d/') || '2104'",
    "'13/45/' || strftime(o_orderdate, '%Y')",
    "'  ' || strftime(o_orderdate, '%Y%m%d') || ' '",
)


def sql_date(expr: str) -> str:
    """Instant (UTC, naive) of a stripped date text."""
    return f"""coalesce(
      try_strptime({expr}, '%m/%d/%Y'), try_strptime({expr}, '%m/%d/%Y %I:%M:%S %p'),
      try_strptime({expr}, '%Y-%m-%d'),
      CASE WHEN regexp_matches({expr}, '^\\d{{8}}$') THEN try_strptime({expr}, '%Y%m%d') END,
      CASE WHEN regexp_matches({expr}, '^\\d{{4}}-\\d\\d-\\d\\dT')
        THEN try_cast({expr} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END)"""


VIEWS = {
    "contributions": f"""
      SELECT CASE WHEN o_orderkey % 101 = 0 THEN c_name || ' 12 Main Street' ELSE {sql_case(
        "o_orderkey % 5", "c_name", "c_name || ' LLC'", "'  ' || lower(c_name) || ', Inc. '",
        "c_name || ' & Sons, L.L.C.'", "c_name || ' Company'")} END AS donor,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'INDIVIDUAL' WHEN o_orderstatus = 'F' THEN ' entity '
          ELSE 'ENTITY' END AS donor_type,
        CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE '$' || {sql_money("o_totalprice")} END AS contribution_amount
      FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL
      SELECT p_name || CASE WHEN p_partkey % 3 = 0 THEN ' LLC' ELSE '' END, 'ENTITY', {sql_money("p_retailprice")}
      FROM part""",
    "echeckbook": f"""
      SELECT upper(c_name) || {sql_case("l_linenumber % 4", "''", "', LLC'", "' INC'", "' L.L.P.'")} AS lgl_nm,
        CASE WHEN l_suppkey % 10 = 0 THEN 'mis' || l_suppkey ELSE 'V' || c_nationkey END AS vend_cust_cd,
        {sql_money("l_extendedprice")} AS amount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "contracts": "SELECT c_name || ' Co.' AS lgl_nm, CASE WHEN c_custkey % 7 <> 0 THEN 'V' || c_nationkey END AS vend_cust_cd FROM customer",
    "purchase_orders": f"""
      SELECT upper(p_name) || CASE p_partkey % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ', L.L.C.' ELSE '' END AS lgl_nm,
        p_brand AS vendor_code, {sql_money("l_extendedprice")} AS itm_tot_am
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "campaign_names": sql_names(
        "campaign-contributions", "donor", "''", sql_amount("contribution_amount"),
        "lower(trim(donor_type)) = 'entity'", "contributions",
    ),
    "public_names": " UNION ALL ".join(
        (
            sql_names("echeckbook", "lgl_nm", "coalesce(trim(vend_cust_cd), '')", sql_amount("amount"),
                      "NOT starts_with(upper(coalesce(trim(vend_cust_cd), '')), 'MIS')", "echeckbook"),
            sql_names("contracts", "lgl_nm", "coalesce(trim(vend_cust_cd), '')", "CAST(0 AS DECIMAL(38,6))",
                      "NOT starts_with(upper(coalesce(trim(vend_cust_cd), '')), 'MIS')", "contracts"),
            sql_names("purchase-orders", "lgl_nm", "trim(vendor_code)", sql_amount("itm_tot_am"),
                      "NOT starts_with(upper(trim(vendor_code)), 'BRAND#1')", "purchase_orders"),
        )
    ),
    "campaign_entities": _ENTITY.format(names="campaign_names"),
    "public_entities": _ENTITY.format(names="public_names"),
    "orders_snapshot": f"""
      SELECT o_orderkey + 2 AS row_number,
        CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderkey - o_orderkey % 3 AS VARCHAR) END AS order_id,
        CAST(o_custkey AS VARCHAR) AS customer_id, ' ' || o_orderstatus AS status,
        CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '$' || {sql_money("o_totalprice")} END AS total,
        CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE {_DATE_SPELLINGS} END AS ordered,
        CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderpriority END AS priority,
        CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'x' END AS note, ' ' AS approved
      FROM orders""",
    "events_snapshot": f"""
      SELECT event_id + 2 AS row_number, CAST(event_id AS VARCHAR) AS event_id,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, CAST(user_id AS VARCHAR) AS user_id, event_type,
        {sql_money("value")} AS value, props
      FROM events""",
    "lineitem_snapshot": f"""
      SELECT CAST(NULL AS BIGINT) AS row_number, CAST(l_orderkey AS VARCHAR) AS l_orderkey,
        CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey,
        CAST(l_linenumber AS VARCHAR) AS l_linenumber, {sql_money("l_quantity")} AS l_quantity,
        {sql_money("l_extendedprice")} AS l_extendedprice, {sql_money("l_discount")} AS l_discount,
        {sql_money("l_tax")} AS l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%m/%d/%Y') AS l_shipdate
      FROM lineitem""",
    "documents_snapshot": """
      SELECT doc_id + 2 AS row_number, CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source,
        CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "conversations_snapshot": """
      SELECT CAST(NULL AS BIGINT) AS row_number, CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
        role, text FROM conversations""",
}
_NEEDS = {
    "campaign_names": ("contributions",),
    "public_names": ("echeckbook", "contracts", "purchase_orders"),
    "campaign_entities": ("campaign_names",),
    "public_entities": ("public_names",),
}


def with_views(body: str, *names: str, **extra: str) -> str:
    """``body`` behind a WITH list of the named views and what they need, then the extra ones."""
    listed: dict[str, str] = {}

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        listed[name] = VIEWS[name]

    for name in names:
        add(name)
    listed.update(extra)
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in listed.items())
    return f"WITH {ctes} {body}" if listed else body
