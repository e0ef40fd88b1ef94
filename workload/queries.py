"""The registered queries. Amounts are summed exactly and shown as doubles, lists as joined text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import digests, pii, text, urls, values
from recordloom.operators import checks, entities, limits, privacy, profile, schema
from recordloom.plans import audit, candidates, cards, gates, review
from recordloom.session import shared_dir, stage
from recordloom.sources import content_index
from recordloom.sources import manifests as M
from recordloom.sources import sinks, snapshot
from recordloom.sources.catalog import read_column_catalog
from recordloom.sources.contracts import SourceContract
from recordloom.sources.inventory import INVENTORY, PUBLIC_SOURCES
from recordloom.sources.layout import lay_out
from recordloom.sources.listing import list_empty_files, list_tree
from workload import tables as T
from workload.tables import sql_case, sql_date, sql_money, sql_strict, sql_suffix, table, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SEPARATOR = " | "


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def double(column: str) -> Column:
    return F.col(column).cast("double").alias(column)


def joined(column: str) -> Column:
    return F.array_join(column, SEPARATOR).alias(column)


# --- text and values ------------------------------------------------------------------------------

_TEXTS = """
  SELECT 'documents' AS kind, doc_id AS id, text AS v FROM documents
  UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 'pages', page_id, html FROM pages
  UNION ALL SELECT 'part', p_partkey, p_name || ', ' || p_type || ' L.L.C.' FROM part
  UNION ALL SELECT 'supplier', s_suppkey, s_name || ' & Co. A.B.C Ltd' FROM supplier"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    def pick(name: str, key: Column, value: Column) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("kind"), key.alias("id"), value.alias("v"))

    out = pick("documents", F.col("doc_id"), F.col("text"))
    for other in (
        pick("benchmark", F.col("item_id"), F.col("text")),
        pick("conversations", F.col("conv_id") * 1000 + F.col("turn"), F.col("text")),
        pick("pages", F.col("page_id"), F.col("html")),
        pick("part", F.col("p_partkey"), F.concat("p_name", F.lit(", "), "p_type", F.lit(" L.L.C."))),
        pick("supplier", F.col("s_suppkey"), F.concat("s_name", F.lit(" & Co. A.B.C Ltd"))),
    ):
        out = out.unionByName(other)
    return out


@query("strict_name_key", f"SELECT kind, id, sha256({sql_strict('v')}) AS strict_key FROM ({_TEXTS})")
def strict_name_key(spark, d):
    return _texts(spark, d).select("kind", "id", F.sha2(text.strict_name_key(F.col("v")), 256).alias("strict_key"))


@query(
    "suffix_key",
    f"""SELECT kind, id, sha256({sql_suffix('s')}) AS suffix_key, s <> {sql_suffix('s')} AS shortened
        FROM (SELECT kind, id, {sql_strict('v')} AS s FROM ({_TEXTS}))""",
)
def suffix_key(spark, d):
    keyed = _texts(spark, d).select("kind", "id", text.strict_name_key(F.col("v")).alias("s"))
    suffix = text.suffix_of_strict_key(F.col("s"))
    return keyed.select("kind", "id", F.sha2(suffix, 256).alias("suffix_key"), (F.col("s") != suffix).alias("shortened"))


@query(
    "canonical_field_name",
    r"""SELECT kind, id, sha256(trim(regexp_replace(lower(regexp_replace(strip_accents(v), '[^\x00-\x7F]', '', 'g')),
        '[^a-z0-9]+', '_', 'g'), '_')) AS field FROM (""" + _TEXTS + ")",
)
def canonical_field_name(spark, d):
    return _texts(spark, d).select("kind", "id", F.sha2(text.canonical_field_name(F.col("v")), 256).alias("field"))


_AMOUNT_TEXT = sql_case(
    "o_orderkey % 6", "'$' || " + sql_money("o_totalprice"), "' ' || " + sql_money("o_totalprice") + " || ' '",
    "'(' || " + sql_money("o_totalprice") + " || ')'", "''", "'-$' || " + sql_money("o_totalprice"), "'n/a'",
)


@query("parse_amount", f"SELECT o_orderkey, CAST({T.sql_amount(_AMOUNT_TEXT)} AS DOUBLE) AS amount FROM orders")
def parse_amount(spark, d):
    key, money = F.col("o_orderkey"), T.money(F.col("o_totalprice"))
    spelled = T._case(
        key % 6, F.concat(F.lit("$"), money), F.concat(F.lit(" "), money, F.lit(" ")),
        F.concat(F.lit("("), money, F.lit(")")), F.lit(""), F.concat(F.lit("-$"), money), F.lit("n/a"),
    )
    return table(spark, d, "orders").select("o_orderkey", values.parse_amount(spelled).cast("double").alias("amount"))


@query(
    "parse_dates",
    with_views(
        f"""SELECT row_number, moment IS NOT NULL AS valid, coalesce(CAST(epoch_us(moment) AS BIGINT), 0) AS micros,
            coalesce(year(moment) < 1900 OR year(moment) > 2046, false) AS suspicious
            FROM (SELECT row_number, {sql_date('trim(ordered)')} AS moment FROM orders_snapshot)""",
        "orders_snapshot",
    ),
)
def parse_dates(spark, d):
    at = T.orders_snapshot(spark, d).select("row_number", values.parse_date(text.strip(F.col("ordered"))).alias("at"))
    return at.select(
        "row_number", F.col("at").isNotNull().alias("valid"),
        F.coalesce(F.unix_micros("at"), F.lit(0)).alias("micros"),
        F.coalesce(values.is_suspicious(F.col("at"), T.AS_OF_YEAR), F.lit(False)).alias("suspicious"),
    )


_ZONED = sql_case(
    "event_id % 5", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'", "strftime(ts, '%Y-%m-%dT%H:%M') || '-05:00'",
    "strftime(ts, '%Y-%m-%d %H:%M:%S')", "strftime(ts, '%Y-%m-%d')", "event_type",
)


@query("aware_timestamp", f"SELECT event_id, regexp_matches({_ZONED}, '^[0-9].*(Z|-05:00)$') AS aware FROM events")
def aware_timestamp(spark, d):
    def at(pattern: str) -> Column:
        return F.date_format("ts", pattern)

    spelled = T._case(
        F.col("event_id") % 5, F.concat(at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")),
        F.concat(at("yyyy-MM-dd'T'HH:mm"), F.lit("-05:00")), at("yyyy-MM-dd HH:mm:ss"), at("yyyy-MM-dd"),
        F.col("event_type"),
    )
    return table(spark, d, "events").select("event_id", values.is_aware_timestamp(spelled).alias("aware"))


_EVIDENCE_URL = sql_case(
    "page_id % 5", "replace(url, 'http://', 'https://')", "url",
    "replace(url, 'http://', 'https://') || ' | https://example.org/x'",
    "replace(url, 'http://', 'https://user:pw@')", "replace(url, 'http://', 'https://') || ' | '",
)


@query(
    "evidence_urls",
    f"""SELECT page_id, len(list_filter(string_split(u, '|'), lambda p: NOT
          regexp_matches(trim(p), '^(?i:https)://[^/?#@]+($|[/?#])'))) = 0 AS valid
        FROM (SELECT page_id, {_EVIDENCE_URL} AS u FROM pages)""",
)
def evidence_urls(spark, d):
    secure = F.replace("url", F.lit("http://"), F.lit("https://"))
    spelled = T._case(
        F.col("page_id") % 5, secure, F.col("url"), F.concat(secure, F.lit(" | https://example.org/x")),
        F.replace("url", F.lit("http://"), F.lit("https://user:pw@")), F.concat(secure, F.lit(" | ")),
    )
    return table(spark, d, "pages").select("page_id", urls.valid_evidence_urls(spelled).alias("valid"))


# --- profiles -------------------------------------------------------------------------------------

_PROFILED = {
    "orders": (T.orders_snapshot, T.ORDERS),
    "events": (T.events_snapshot, T.EVENTS),
    "lineitem": (T.lineitem_snapshot, T.LINEITEM),
    "documents": (T.documents_snapshot, T.DOCUMENTS),
    "conversations": (T.conversations_snapshot, T.CONVERSATIONS),
}
# Columns the SQL views have, per snapshot (a contract may also list fields that are absent).
_SQL_COLUMNS = {
    name: tuple(c for c in contract.columns if c != "channel") for name, (_, contract) in _PROFILED.items()
}


def _sql_long(name: str, columns: tuple[str, ...]) -> str:
    """(source, field, row_number, value) of the given columns, blanks as null."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS source, '{c}' AS field, row_number, nullif(trim({c}, ' ' || chr(9) || chr(10)), '') AS value "
        f"FROM {name}_snapshot"
        for c in columns
    )


def _sql_profile(select: str, columns: Callable[[str], tuple[str, ...]]) -> str:
    parts = [_sql_long(name, columns(name)) for name in _PROFILED if columns(name)]
    return with_views(select, *[f"{n}_snapshot" for n in _PROFILED], long=" UNION ALL ".join(parts))


def _all_sources(run: Callable[[DataFrame, SourceContract], DataFrame]) -> Query:
    def union(spark: SparkSession, d: str) -> DataFrame:
        out = None
        for make, contract in _PROFILED.values():
            part = run(make(spark, d), contract)
            if part is not None:
                part = part.withColumn("source", F.lit(contract.slug))
                out = part if out is None else out.unionByName(part)
        return out

    return union


def _tracked(name: str) -> tuple[str, ...]:
    return tuple(c for c in _PROFILED[name][1].tracked_fields if c in _SQL_COLUMNS[name])


def _role(role: str) -> Callable[[str], tuple[str, ...]]:
    return lambda name: tuple(c for c in _PROFILED[name][1].fields(role) if c in _SQL_COLUMNS[name])


query(
    "profile_nulls",
    _sql_profile(
        """SELECT source, field, count(*) AS rows, count(*) - count(value) AS nulls,
           (count(*) - count(value)) / count(*) AS null_rate FROM long GROUP BY source, field""",
        lambda n: _SQL_COLUMNS[n],
    ),
)(_all_sources(lambda df, c: profile.null_counts(df).withColumn("null_rate", F.col("nulls") / F.col("rows"))))

query(
    "profile_distinct",
    _sql_profile(
        'SELECT source, field, count(DISTINCT value) AS "distinct" FROM long WHERE value IS NOT NULL GROUP BY source, field',
        _tracked,
    ),
)(_all_sources(lambda df, c: profile.distinct_counts(df, [f for f in c.tracked_fields if f in df.columns])))

_COUNTED = """(SELECT source, field, value, count(*) AS n, min(row_number) AS first_row
  FROM long WHERE value IS NOT NULL GROUP BY source, field, value)"""

query(
    "profile_top25",
    _sql_profile(
        f"""SELECT source, field, rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY source, field
            ORDER BY n DESC, first_row NULLS LAST, value) AS rank FROM {_COUNTED}) WHERE rank <= 25""",
        _role("category"),
    ),
)(_all_sources(
    lambda df, c: profile.top_values(df, list(c.fields("category"))).withColumn("rank", F.col("rank").cast("bigint"))
))

_DATED = f"""(SELECT *, coalesce(year(moment) < 1900 OR year(moment) > {T.AS_OF_YEAR + 20}, false) AS odd
  FROM (SELECT *, {sql_date('value')} AS moment FROM {_COUNTED}))"""


def _dates(df: DataFrame, c: SourceContract) -> DataFrame | None:
    fields = list(c.fields("date"))
    if not fields:
        return None
    ranges = profile.date_ranges(df, fields, T.AS_OF_YEAR)
    examples = profile.suspicious_examples(df, fields, T.AS_OF_YEAR)
    out = ranges.join(F.broadcast(examples), "field", "left")
    return out.withColumn("examples", F.coalesce(F.array_join("suspicious_date_examples", SEPARATOR), F.lit(""))).drop(
        "suspicious_date_examples"
    )


query(
    "profile_dates",
    _sql_profile(
        f"""SELECT source, field,
          first(value ORDER BY moment, first_row, value) FILTER (moment IS NOT NULL) AS minimum,
          first(value ORDER BY moment DESC, first_row, value DESC) FILTER (moment IS NOT NULL) AS maximum,
          CAST(coalesce(sum(n) FILTER (moment IS NULL), 0) AS BIGINT) AS invalid_date_count,
          CAST(coalesce(sum(n) FILTER (odd), 0) AS BIGINT) AS suspicious_date_count,
          coalesce(string_agg(value, ' | ' ORDER BY value) FILTER (odd AND odd_rank <= 5), '') AS examples
        FROM (SELECT *, row_number() OVER (PARTITION BY source, field, odd ORDER BY first_row, value) AS odd_rank
              FROM {_DATED}) GROUP BY source, field""",
        _role("date"),
    ),
)(_all_sources(_dates))

query(
    "profile_duplicates",
    _sql_profile(
        "SELECT source, field, count(value) - count(DISTINCT value) AS duplicates FROM long GROUP BY source, field",
        _role("unique"),
    ),
)(_all_sources(lambda df, c: profile.duplicate_counts(df, list(c.fields("unique")))))

_FLOORS = " UNION ALL ".join(
    f"""SELECT '{n}' AS source, count(*) AS row_count, CAST({c.expected_minimum_rows} AS BIGINT) AS expected_minimum_rows,
        count(*) >= {c.expected_minimum_rows} AS meets_expected_minimum FROM {n}"""
    for n, (_, c) in _PROFILED.items()
)
query("row_floor", _FLOORS)(_all_sources(profile.row_floor))


@query(
    "profile_summary",
    f"""SELECT source, row_count, meets_expected_minimum,
        CAST(CASE WHEN source = 'events' THEN 1 ELSE 0 END AS BIGINT) AS missing_fields FROM ({_FLOORS})""",
)
def profile_summary(spark, d):
    headers = _all_sources(lambda df, c: profile.profile_source(df, c, "a", "t"))(spark, d)
    return profile.profile_summary(headers)


@query(
    "profile_orders",
    with_views(
        f"""SELECT field, rows, nulls, nulls / rows AS null_rate,
          CASE WHEN field <> 'note' AND n_distinct > 0 THEN n_distinct END AS "distinct",
          coalesce(top, '') AS top_values, minimum, maximum,
          CASE WHEN field IN ('ordered', 'approved') THEN coalesce(invalid_date_count, 0) END AS invalid_date_count,
          CASE WHEN field IN ('ordered', 'approved') THEN coalesce(suspicious_date_count, 0) END AS suspicious_date_count,
          CASE WHEN field IN ('ordered', 'approved') THEN coalesce(examples, '') END AS examples, duplicates
        FROM (SELECT field, count(*) AS rows, count(*) - count(value) AS nulls, count(DISTINCT value) AS n_distinct FROM long GROUP BY field)
        LEFT JOIN (SELECT field, string_agg(value || '=' || n, ' | ' ORDER BY n DESC, first_row) AS top
          FROM (SELECT field, value, count(*) AS n, min(row_number) AS first_row FROM long
                WHERE value IS NOT NULL AND field IN ('status', 'priority') GROUP BY field, value) GROUP BY field)
          USING (field)
        LEFT JOIN (SELECT * EXCLUDE source FROM ({ORACLE["profile_dates"]}) WHERE source = 'orders') USING (field)
        LEFT JOIN (SELECT * EXCLUDE source FROM ({ORACLE["profile_duplicates"]}) WHERE source = 'orders') USING (field)""",
        "orders_snapshot",
        long=_sql_long("orders", _SQL_COLUMNS["orders"]),
    ),
)
def profile_orders(spark, d):
    fields = profile.profile_fields(T.orders_snapshot(spark, d), T.ORDERS, T.AS_OF_YEAR)
    top = F.array_join(F.transform("top_values", lambda t: F.concat_ws("=", t["value"], t["n"])), SEPARATOR)
    return fields.select(
        "field", "rows", "nulls", "null_rate", "distinct", F.coalesce(top, F.lit("")).alias("top_values"), "minimum", "maximum",
        "invalid_date_count", "suspicious_date_count", F.array_join("suspicious_date_examples", SEPARATOR).alias("examples"), "duplicates",
    )


# --- entities and candidates ----------------------------------------------------------------------

_ENTITY_SQL = """SELECT source, strict_key, suffix_key, code, CAST(rows AS BIGINT) AS rows,
  CAST(amount AS DOUBLE) AS amount, display_name, spellings, first_name, last_name FROM {}"""


def _entity_rows(names: DataFrame) -> DataFrame:
    spellings = names.groupBy("source", "strict_key", "code").agg(
        F.count_distinct("name").alias("spellings"), F.min("name").alias("first_name"), F.max("name").alias("last_name")
    )
    return entities.entities(names).join(spellings, ["source", "strict_key", "code"]).select(
        "source", "strict_key", "suffix_key", "code", "rows", double("amount"), "display_name",
        "spellings", "first_name", "last_name",
    )


def _campaign_names(spark, d):
    source = T.campaign_source(spark, d)
    return entities.campaign_names(source.df, source.contract)


def _public_names(spark, d):
    out = None
    for source in T.public_sources(spark, d):
        names = entities.public_names(source.df, source.contract)
        out = names if out is None else out.unionByName(names)
    return out


@query("campaign_entities", with_views(_ENTITY_SQL.format("campaign_entities"), "campaign_entities"))
def campaign_entities(spark, d):
    return _entity_rows(stage(_campaign_names(spark, d), "names"))


@query("public_entities", with_views(_ENTITY_SQL.format("public_entities"), "public_entities"))
def public_entities(spark, d):
    return _entity_rows(stage(_public_names(spark, d), "names"))


@query(
    "suffix_ambiguity",
    with_views(
        """SELECT suffix_key, count(DISTINCT strict_key) AS strict_keys FROM public_names
           WHERE suffix_key <> '' GROUP BY suffix_key""",
        "public_names",
    ),
)
def suffix_ambiguity(spark, d):
    return entities.keys_per_suffix(_public_names(spark, d))


_PAIRS = """
  SELECT substr(sha256(concat_ws('|', c.strict_key, p.strict_key, p.source, p.code)), 1, 16) AS candidate_id,
    CASE WHEN c.strict_key = p.strict_key THEN 'A_STRICT' ELSE 'B_LEGAL_SUFFIX' END AS evidence_tier,
    c.display_name AS campaign_name, c.names AS campaign_names_aggregated, p.display_name AS public_record_name,
    p.names AS public_record_names_aggregated, p.source AS public_record_source, p.code AS public_record_code,
    c.strict_key AS strict_campaign_key, p.strict_key AS strict_public_key, p.suffix_key AS suffix_candidate_key,
    CAST(c.rows AS BIGINT) AS campaign_rows, CAST(p.rows AS BIGINT) AS public_record_rows,
    CAST(c.amount AS DOUBLE) AS campaign_amount,
    CASE WHEN p.source <> 'contracts' THEN CAST(p.amount AS DOUBLE) END AS public_record_amount,
    c.name_list AS campaign_list, p.name_list AS public_list
  FROM campaign_entities c JOIN public_entities p ON c.suffix_key = p.suffix_key
  WHERE p.suffix_key <> '' OR c.strict_key = p.strict_key"""
_RANKED = """
  SELECT *, row_number() OVER (PARTITION BY evidence_tier ORDER BY campaign_rows DESC, public_record_rows DESC,
      lower(campaign_name), lower(public_record_name), strict_campaign_key, strict_public_key,
      public_record_source, public_record_code) AS in_tier FROM pairs"""
_SELECTED = """
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY phase, evidence_tier, in_tier) AS position FROM (
    SELECT *, CASE WHEN evidence_tier = 'A_STRICT' AND in_tier <= ({n} + 1) // 2 THEN 0
      WHEN evidence_tier = 'B_LEGAL_SUFFIX' AND in_tier <= {n} - ({n} + 1) // 2 THEN 1 ELSE 2 END AS phase
    FROM ranked)) WHERE position <= {n}"""


def _sql_in(field: str, values_sql: str) -> str:
    quoted = f"list_transform({values_sql}, lambda x: '''' || replace(x, '''', '''''') || '''')"
    return (
        f"CASE WHEN len({values_sql}) = 1 THEN '{field} = ' || ({quoted})[1] "
        f"ELSE '{field} in (' || array_to_string({quoted}, ', ') || ')' END"
    )


def _sql_url(contract: SourceContract, where: str) -> str:
    fields = ",".join(contract.public_fields)
    return (
        f"'{contract.portal}/resource/{contract.dataset_id}.json?%24select=' || url_encode('{fields}') || "
        f"'&%24where=' || url_encode({where}) || '&%24limit=50000'"
    )


_CAMPAIGN_URL = _sql_url(
    INVENTORY.require("campaign-contributions"),
    _sql_in("donor", "campaign_list") + " || ' AND donor_type = ''ENTITY'''",
)
_PUBLIC_URL = (
    "CASE public_record_source WHEN 'echeckbook' THEN "
    + _sql_url(INVENTORY.require("echeckbook"), _sql_in("lgl_nm", "public_list") + " || ' AND vend_cust_cd = ''' || public_record_code || ''''")
    + " WHEN 'contracts' THEN "
    + _sql_url(INVENTORY.require("contracts"), _sql_in("lgl_nm", "public_list") + " || ' AND vend_cust_cd = ''' || public_record_code || ''''")
    + " ELSE "
    + _sql_url(T.PURCHASE_ORDERS, _sql_in("lgl_nm", "public_list") + " || ' AND vendor_code = ''' || public_record_code || ''''")
    + " END"
)
_CANDIDATE_VIEWS = ("campaign_entities", "public_entities")


def _sql_candidates(select: str, limit: int) -> str:
    return with_views(select, *_CANDIDATE_VIEWS, pairs=_PAIRS, ranked=_RANKED, selected=_SELECTED.format(n=limit))


LIMIT = 50
_CANDIDATES_SQL = _sql_candidates(
    f"""SELECT candidate_id, evidence_tier, campaign_name, campaign_names_aggregated, public_record_name,
      public_record_names_aggregated, public_record_source, public_record_code, strict_campaign_key, strict_public_key,
      suffix_candidate_key, campaign_rows, public_record_rows, 'contribution_amount' AS campaign_amount_field,
      campaign_amount, CASE public_record_source WHEN 'echeckbook' THEN 'amount' WHEN 'purchase-orders' THEN 'itm_tot_am'
        ELSE '' END AS public_record_amount_field,
      coalesce(public_record_amount, 0) AS public_record_amount,
      repeat('a', 64) AS campaign_artifact_sha256,
      CASE public_record_source WHEN 'echeckbook' THEN repeat('e', 64) WHEN 'contracts' THEN repeat('c', 64)
        ELSE repeat('b', 64) END AS public_record_artifact_sha256,
      {_CAMPAIGN_URL} AS campaign_source_rows_url, {_PUBLIC_URL} AS public_record_source_rows_url,
      (SELECT count(DISTINCT strict_key) FROM campaign_names n WHERE n.suffix_key = suffix_candidate_key) AS campaign_keys_for_suffix,
      (SELECT count(DISTINCT strict_key) FROM public_names n WHERE n.suffix_key = suffix_candidate_key) AS public_keys_for_suffix,
      'UNREVIEWED' AS review_status, '' AS same_organization, '' AS external_evidence_url, '' AS review_notes, position
    FROM selected""",
    LIMIT,
)


def _candidates(spark, d, limit: int = LIMIT) -> DataFrame:
    return candidates.generate_candidates(T.campaign_source(spark, d), T.public_sources(spark, d), limit)


@query("candidates", _CANDIDATES_SQL)
def generate_candidates(spark, d):
    made = _candidates(spark, d).withColumns({
        "campaign_amount": F.col("campaign_amount").cast("double"),
        "public_record_amount": F.coalesce(F.col("public_record_amount").cast("double"), F.lit(0.0)),
        "position": F.col("position").cast("bigint"),
    })
    return made


_COUNTS_SQL = """
  SELECT s.source AS public_record_source, t.tier AS evidence_tier,
    count(p.public_record_source) AS pairs
  FROM (SELECT DISTINCT source FROM public_entities) s
    CROSS JOIN (SELECT unnest(['A_STRICT', 'B_LEGAL_SUFFIX']) AS tier) t
    LEFT JOIN pairs p ON p.public_record_source = s.source AND p.evidence_tier = t.tier
  GROUP BY s.source, t.tier"""


@query("candidate_counts", with_views(_COUNTS_SQL, *_CANDIDATE_VIEWS, pairs=_PAIRS))
def candidate_counts(spark, d):
    names = candidates.staged_names(T.campaign_source(spark, d), T.public_sources(spark, d))
    return candidates.candidate_counts(*names)


@query(
    "stratified_limit",
    """SELECT o_orderkey, evidence_tier, CAST(position AS BIGINT) AS position FROM (
         SELECT *, row_number() OVER (ORDER BY phase, evidence_tier, in_tier) AS position FROM (
           SELECT *, CASE WHEN evidence_tier = 'A_STRICT' AND in_tier <= 51 THEN 0
             WHEN evidence_tier = 'B_LEGAL_SUFFIX' AND in_tier <= 50 THEN 1 ELSE 2 END AS phase FROM (
             SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 499000 THEN 'A_STRICT' ELSE 'B_LEGAL_SUFFIX' END AS evidence_tier,
               row_number() OVER (PARTITION BY o_totalprice > 499000 ORDER BY o_custkey DESC, o_orderkey) AS in_tier
             FROM orders))) WHERE position <= 101""",
)
def stratified_limit(spark, d):
    tiered = table(spark, d, "orders").withColumn(
        "evidence_tier", F.when(F.col("o_totalprice") > 499000, limits.STRICT).otherwise(limits.SUFFIX)
    )
    chosen = limits.stratified_limit(tiered, 101, [F.desc("o_custkey"), F.col("o_orderkey")])
    return chosen.select("o_orderkey", "evidence_tier", F.col("position").cast("bigint").alias("position"))


@query(
    "later_occurrences",
    """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
       FROM orders) WHERE n > 1""",
)
def later_occurrences(spark, d):
    return limits.later_occurrences(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


# --- audit ----------------------------------------------------------------------------------------


@query(
    "audit_campaign",
    with_views(
        """SELECT CAST(sum(rows) AS BIGINT) AS rows, count(DISTINCT name) AS raw_names, count(DISTINCT strict_key) AS strict_name_keys,
           count(DISTINCT nullif(suffix_key, '')) AS suffix_candidate_keys, CAST(sum(amount) AS DOUBLE) AS amount
           FROM campaign_names""",
        "campaign_names",
    ),
)
def audit_campaign(spark, d):
    return audit.campaign_population(_campaign_names(spark, d)).withColumn("amount", F.col("amount").cast("double"))


_PLACEHOLDERS = """
  SELECT 'echeckbook' AS source, count(*) AS invalid_code_rows, count(DISTINCT nullif(trim(lgl_nm), '')) AS invalid_code_names,
    count(DISTINCT vend_cust_cd) AS invalid_codes FROM echeckbook WHERE upper(trim(vend_cust_cd)) LIKE 'MIS%'
  UNION ALL SELECT 'contracts', count(*), count(DISTINCT nullif(trim(lgl_nm), '')), count(DISTINCT vend_cust_cd)
    FROM contracts WHERE upper(trim(vend_cust_cd)) LIKE 'MIS%'
  UNION ALL SELECT 'purchase-orders', count(*), count(DISTINCT nullif(trim(lgl_nm), '')), count(DISTINCT vendor_code)
    FROM purchase_orders WHERE upper(trim(vendor_code)) LIKE 'BRAND#1%'"""


@query("placeholder_codes", with_views(_PLACEHOLDERS, "echeckbook", "contracts", "purchase_orders"))
def placeholder_codes(spark, d):
    return audit.placeholder_summary(T.public_sources(spark, d))


@query(
    "audit_public",
    with_views(
        """SELECT source, eligible_rows, eligible_raw_names, eligible_codes, strict_name_keys, suffix_candidate_keys,
             exact_strict_key_overlap, legal_suffix_key_overlap, invalid_code_rows, invalid_code_names, invalid_codes,
             CASE WHEN source = 'purchase-orders' THEN 'Brand#1' ELSE 'MIS' END AS invalid_code_prefixes
           FROM (SELECT source, CAST(sum(rows) AS BIGINT) AS eligible_rows, count(DISTINCT name) AS eligible_raw_names,
               count(DISTINCT code) AS eligible_codes, count(DISTINCT strict_key) AS strict_name_keys,
               count(DISTINCT nullif(suffix_key, '')) AS suffix_candidate_keys,
               count(DISTINCT strict_key) FILTER (strict_key IN (SELECT strict_key FROM campaign_names)) AS exact_strict_key_overlap,
               count(DISTINCT suffix_key) FILTER (suffix_key <> '' AND suffix_key IN (SELECT suffix_key FROM campaign_names))
                 AS legal_suffix_key_overlap
             FROM public_names GROUP BY source) JOIN (""" + _PLACEHOLDERS + ") USING (source)",
        "campaign_names",
        "public_names",
    ),
)
def audit_public(spark, d):
    public = T.public_sources(spark, d)
    left, right = candidates.staged_names(T.campaign_source(spark, d), public)
    return audit.public_audit(left, right, public).drop("artifact_sha256")


@query(
    "matched_keys",
    with_views(
        """SELECT count(DISTINCT strict_key) AS matched_campaign_keys FROM campaign_names
           WHERE strict_key IN (SELECT strict_key FROM public_names)
             OR (suffix_key <> '' AND suffix_key IN (SELECT suffix_key FROM public_names))""",
        "campaign_names",
        "public_names",
    ),
)
def matched_keys(spark, d):
    left, right = candidates.staged_names(T.campaign_source(spark, d), T.public_sources(spark, d))
    return audit.matched_campaign_keys(left, right).groupBy().agg(F.count("*").alias("matched_campaign_keys"))


@query(
    "audit_candidates",
    _sql_candidates(
        """SELECT 'evidence_tier' AS dimension, evidence_tier AS value, count(*) AS candidates FROM selected GROUP BY 2
           UNION ALL SELECT 'public_record_source', public_record_source, count(*) FROM selected GROUP BY 2
           UNION ALL SELECT 'all', 'campaign_keys', count(DISTINCT strict_campaign_key) FROM selected
           UNION ALL SELECT 'all', 'reviewed_rows', 0""",
        400,
    ),
)
def audit_candidates(spark, d):
    return audit.candidate_counters(stage(_candidates(spark, d, 400), "candidates"))


@query(
    "audit_suspicious_dates",
    _sql_profile(
        f"""SELECT source, field, CAST(sum(n) FILTER (odd) AS BIGINT) AS suspicious_date_count FROM {_DATED}
            GROUP BY source, field HAVING count(*) FILTER (odd) > 0""",
        _role("date"),
    ),
)
def audit_suspicious_dates(spark, d):
    fields = _all_sources(
        lambda df, c: profile.profile_fields(df, c, T.AS_OF_YEAR) if c.fields("date") else None
    )(spark, d)
    return audit.suspicious_dates(fields).drop("suspicious_date_examples")


_CARD_NAMES = ("Customer#000000001", "Customer#000000001 LLC", "customer#000000001, Inc.")
_CARD_PUBLIC = ("CUSTOMER#000000001", "CUSTOMER#000000001, LLC")


@query(
    "organization_card",
    with_views(
        f"""SELECT 'campaign' AS side, 'campaign-contributions' AS source, count(*) AS rows,
              CAST(coalesce(sum({T.sql_amount('contribution_amount')}), 0) AS DOUBLE) AS amount
            FROM contributions WHERE trim(donor) IN {_CARD_NAMES} AND lower(trim(donor_type)) = 'entity'
            UNION ALL SELECT 'public', 'echeckbook', count(*), CAST(coalesce(sum({T.sql_amount('amount')}), 0) AS DOUBLE)
            FROM echeckbook WHERE trim(lgl_nm) IN {_CARD_PUBLIC} AND vend_cust_cd = 'V19'""",
        "contributions",
        "echeckbook",
    ),
)
def organization_card(spark, d):
    card = cards.organization_card(
        T.campaign_source(spark, d), T.public_sources(spark, d)[0], _CARD_NAMES, _CARD_PUBLIC, "V19"
    )
    return card.withColumn("amount", F.col("amount").cast("double"))


# --- privacy --------------------------------------------------------------------------------------

TEXTS = SourceContract("texts", "texts", "Texts", {"text": (), "lang": (), "source": (), "doc_id": ("unique",)})
PAGES = SourceContract("pages", "pages", "Pages", {"url": (), "html": (), "page_id": ("unique",)})
PEOPLE = SourceContract(
    "people", "people", "People",
    {"note": (), "contact_key": (), "who": ("identity",), "home_address": ("restricted",)},
)


def _documents(spark, d):
    return table(spark, d, "documents").select(
        (F.col("doc_id") + 2).alias("row_number"), F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source"
    )


def _pages(spark, d):
    return table(spark, d, "pages").select(
        (F.col("page_id") + 2).alias("row_number"), F.col("page_id").cast("string").alias("page_id"), "url", "html"
    )


def _people(spark, d):
    """Rows with every kind of personal data, in a free-text, a key and a name column."""
    key = F.col("o_orderkey")
    digits = F.lpad(key.cast("string"), 4, "5")
    note = T._case(
        key % 8,
        F.concat(F.lit("reach c"), key, F.lit("@example.com now")),
        F.concat(F.lit("call (512) 555-"), digits),
        F.concat(F.lit("ssn 123-45-"), digits),
        F.concat(F.lit("mail P.O. Box "), key),
        F.concat(key, F.lit(" North Main Street, phone 512.555."), digits),
        F.concat(F.lit("invoice "), key),
        F.lit(""),
        F.lit("   "),
    )
    return table(spark, d, "orders").select(
        (key + 2).alias("row_number"),
        note.alias("note"),
        F.concat(F.lit("512555"), digits).alias("contact_key"),
        F.when(key % 10 == 0, F.concat(key, F.lit(" Elm Ave"))).otherwise("Example Organization LLC").alias("who"),
        F.concat(key, F.lit(" Oak Street")).alias("home_address"),
    )


_SQL_DOCUMENTS = "SELECT doc_id + 2 AS row_number, CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents"
_SQL_PAGES = "SELECT page_id + 2 AS row_number, CAST(page_id AS VARCHAR) AS page_id, url, html FROM pages"
_DIGITS = "CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '5') ELSE substr(CAST(o_orderkey AS VARCHAR), 1, 4) END"
_SQL_PEOPLE = f"""SELECT o_orderkey + 2 AS row_number, {sql_case(
    "o_orderkey % 8", "'reach c' || o_orderkey || '@example.com now'", f"'call (512) 555-' || {_DIGITS}",
    f"'ssn 123-45-' || {_DIGITS}", "'mail P.O. Box ' || o_orderkey",
    f"o_orderkey || ' North Main Street, phone 512.555.' || {_DIGITS}", "'invoice ' || o_orderkey", "''", "'   '")} AS note,
  '512555' || {_DIGITS} AS contact_key,
  CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey || ' Elm Ave' ELSE 'Example Organization LLC' END AS who FROM orders"""
_FOUND = "row_number, field, kind, preview, CAST(field_position AS BIGINT) AS field_position, CAST(pattern_position AS BIGINT) AS pattern_position"


def _sql_scan(view: str, sql: str, columns: tuple[str, ...], exempt: tuple[str, ...] = (), select: str = f"SELECT {_FOUND} FROM found") -> str:
    return with_views(select, **{view: sql, "found": T.sql_pii_rows(view, "row_number", columns, exempt)})


def _found(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("field_position", "pattern_position")})


@query("pii_scan_documents", _sql_scan("docs", _SQL_DOCUMENTS, ("text", "lang", "source", "doc_id"), ("doc_id",)))
def pii_scan_documents(spark, d):
    return _found(privacy.audit_source(_documents(spark, d), TEXTS))


@query("pii_scan_pages", _sql_scan("docs", _SQL_PAGES, ("url", "html", "page_id"), ("page_id",)))
def pii_scan_pages(spark, d):
    return _found(privacy.audit_source(_pages(spark, d), PAGES))


@query(
    "pii_scan_conversations",
    _sql_scan("docs", """SELECT conv_id * 1000 + turn AS row_number, text || CASE (conv_id + turn) % 9 WHEN 0 THEN ' ring 206 555 0143'
      WHEN 1 THEN ' or desk@mill.example' WHEN 2 THEN ' at 9 Old Mill Rd' ELSE '' END AS text, role FROM conversations""",
        ("text", "role"),
    ),
)
def pii_scan_conversations(spark, d):
    case = (F.col("conv_id") + F.col("turn")) % 9
    planted = (
        F.when(case == 0, " ring 206 555 0143").when(case == 1, " or desk@mill.example").when(case == 2, " at 9 Old Mill Rd").otherwise("")
    )
    rows = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_number"), F.concat("text", planted).alias("text"), "role"
    )
    return _found(privacy.pii_scan(rows, ["text", "role"]))


@query("pii_scan_people", _sql_scan("people", _SQL_PEOPLE, ("note", "contact_key", "who"), ("contact_key",)))
def pii_scan_people(spark, d):
    return _found(privacy.audit_source(_people(spark, d), PEOPLE))


@query(
    "pii_first_n",
    _sql_scan(
        "people", _SQL_PEOPLE, ("note", "contact_key", "who"), ("contact_key",),
        """SELECT row_number, field, kind, preview, (SELECT count(*) FROM found) AS total_findings FROM found
           ORDER BY row_number, field_position, pattern_position LIMIT 25""",
    ),
)
def pii_first_n(spark, d):
    return privacy.first_findings(privacy.audit_source(_people(spark, d), PEOPLE), 25)


@query(
    "pii_counts",
    _sql_scan(
        "docs", _SQL_DOCUMENTS, ("text", "lang", "source", "doc_id"), ("doc_id",),
        "SELECT field, kind, count(*) AS findings, count(DISTINCT row_number) AS records FROM found GROUP BY field, kind",
    ),
)
def pii_counts(spark, d):
    return privacy.audit_counts(_documents(spark, d), TEXTS)


@query("contains_pii", f"SELECT row_number, {T.sql_pii('who')} AS who_pii, {T.sql_pii('note')} AS note_pii FROM ({_SQL_PEOPLE})")
def contains_pii(spark, d):
    return _people(spark, d).select(
        "row_number", pii.contains_pii(F.col("who")).alias("who_pii"), pii.contains_pii(F.col("note")).alias("note_pii")
    )


@query(
    "check_public",
    _sql_scan("people", _SQL_PEOPLE, ("who", "note"), (), f"SELECT {_FOUND} FROM found"),
)
def check_public(spark, d):
    return _found(privacy.check_public(_people(spark, d).select("row_number", "who", "note"), PEOPLE))


_REDACT = SourceContract(
    "orders", "orders", "Orders",
    {"order_id": (), "customer_id": ("identity",), "status": ("category",), "total": ("amount",), "ordered": ("date",),
     "priority": (), "note": ("restricted",)},
)


@query(
    "redact_table",
    with_views(
        """SELECT row_number, CASE WHEN order_id = '' THEN '' ELSE format('SYNTHETIC-{:04d}', row_number - 1) END AS order_id,
             format('SYNTHETIC-{:04d}', row_number - 1) AS customer_id,
             format('SYNTHETIC STATUS {:04d}', row_number - 1) AS status,
             CASE WHEN total = '' THEN '' ELSE (row_number - 1) || '.00' END AS total,
             CASE WHEN trim(ordered) = '' THEN '' ELSE format('2000-01-{:02d}T00:00:00.000', (row_number - 2) % 28 + 1) END AS ordered,
             CASE WHEN trim(priority) = '' THEN '' ELSE format('SYNTHETIC PRIORITY {:04d}', row_number - 1) END AS priority
           FROM orders_snapshot""",
        "orders_snapshot",
    ),
)
def redact_table(spark, d):
    return privacy.redact(T.orders_snapshot(spark, d), _REDACT)


# --- schema ---------------------------------------------------------------------------------------
# One catalog column per customer; the nation is the source.

_SQL_CATALOG = """SELECT 'nation' || c_nationkey AS source, CAST(c_custkey AS BIGINT) AS position,
  CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE c_name || ' (' || lower(c_mktsegment) || ')' END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'Cust ' || c_custkey ELSE 'cust_' || (c_custkey // 50) END AS field_name,
  'text' AS data_type, c_mktsegment || ' column' AS description FROM customer"""
_API = "CASE WHEN field_name <> '' THEN field_name ELSE name END"


def _sql_canonical(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', '_', 'g'), '_')"


_SQL_NAMED = f"SELECT *, {_sql_canonical(_API)} AS field, {_sql_canonical('name')} AS display FROM catalog"
_SQL_FIELDS = """SELECT 'nation' || c_nationkey AS source, 'cust_' || c_custkey AS field,
  CASE c_custkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' WHEN 2 THEN 'date' ELSE 'public' END AS role,
  CAST(c_custkey AS INT) AS position FROM customer"""
_SQL_PATTERNS = "SELECT 'nation' || n_nationkey AS source, unnest(['9', CASE WHEN n_nationkey % 2 = 0 THEN 'Machin' ELSE 'auto' END]) AS pattern FROM nation"
_SQL_FLAGGED = """SELECT n.*, EXISTS (SELECT 1 FROM fields f WHERE f.source = n.source AND f.field = n.field AND f.role = 'public') AS is_public,
  EXISTS (SELECT 1 FROM fields f WHERE f.source = n.source AND f.field = n.field AND f.role = 'restricted')
    OR EXISTS (SELECT 1 FROM patterns p WHERE p.source = n.source AND contains(lower(n.field), lower(p.pattern))) AS is_restricted
  FROM named n"""
_SCHEMA_SQL = dict(catalog=_SQL_CATALOG, fields=_SQL_FIELDS, patterns=_SQL_PATTERNS, named=_SQL_NAMED, flagged=_SQL_FLAGGED)
_CLASS = "CASE WHEN is_public THEN 'PUBLIC_ALLOWLISTED' WHEN is_restricted THEN 'RESTRICTED' ELSE 'INTERNAL_REVIEW' END"


def _catalog(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("nation"), "c_nationkey").alias("source"),
        key.alias("position"),
        F.when(key % 7 == 0, F.col("c_mktsegment"))
        .otherwise(F.concat("c_name", F.lit(" ("), F.lower("c_mktsegment"), F.lit(")"))).alias("name"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("Cust "), key))
        .otherwise(F.concat(F.lit("cust_"), F.floor(key / 50))).alias("field_name"),
        F.lit("text").alias("data_type"),
        F.concat("c_mktsegment", F.lit(" column")).alias("description"),
    )


def _fields(spark, d):
    key = F.col("c_custkey")
    role = T._case(key % 4, F.lit("public"), F.lit("restricted"), F.lit("date"), F.lit("public"))
    return table(spark, d, "customer").select(
        F.concat(F.lit("nation"), "c_nationkey").alias("source"), F.concat(F.lit("cust_"), key).alias("field"),
        role.alias("role"), key.cast("int").alias("position"),
    )


def _patterns(spark, d):
    second = F.when(F.col("n_nationkey") % 2 == 0, "Machin").otherwise("auto")
    return table(spark, d, "nation").select(
        F.concat(F.lit("nation"), "n_nationkey").alias("source"), F.explode(F.array(F.lit("9"), second)).alias("pattern")
    )


@query(
    "column_map",
    with_views(
        """SELECT source, observed, CASE WHEN count(DISTINCT field) = 1 THEN min(field) ELSE '' END AS field,
             count(DISTINCT field) AS meanings
           FROM (SELECT source, field, field AS observed FROM named UNION ALL SELECT source, field, display FROM named)
           GROUP BY source, observed""",
        **_SCHEMA_SQL,
    ),
)
def column_map(spark, d):
    return schema.column_map(_catalog(spark, d)).withColumn("field", F.coalesce("field", F.lit("")))


@query(
    "name_collisions",
    with_views(
        "SELECT source, display AS field, count(*) AS headers FROM named GROUP BY source, display HAVING count(*) > 1",
        **_SCHEMA_SQL,
    ),
)
def name_collisions(spark, d):
    return schema.name_collisions(_catalog(spark, d))


# One header for each customer: some cells are empty, repeated, without a letter, or alike but for case and signs.
_SQL_HEADERS = """SELECT c_custkey, ['Id', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Name (full)' END,
  CASE WHEN c_custkey % 5 = 0 THEN 'Id' ELSE 'No. ' || c_custkey END, CASE WHEN c_custkey % 7 = 0 THEN '--' ELSE 'x' END,
  CASE WHEN c_custkey % 11 = 0 THEN 'name-full' ELSE 'y' END] AS header FROM customer"""


@query(
    "header_violations",
    f"""SELECT source, unnest(list_filter([CASE WHEN list_contains(header, '') THEN 'empty_cell' END,
            CASE WHEN len(filled) > len(cells) THEN 'repeated_cell' END, CASE WHEN list_contains(names, '') THEN 'unusable_name' END,
            CASE WHEN len(usable) > len(list_distinct(usable)) THEN 'colliding_names' END], lambda r: r IS NOT NULL)) AS rule
        FROM (SELECT *, list_filter(names, lambda n: n <> '') AS usable FROM (SELECT *, list_transform(cells, lambda c:
            trim(regexp_replace(lower(c), '[^a-z0-9]+', '_', 'g'), '_')) AS names FROM (SELECT *, list_distinct(filled) AS cells FROM (
              SELECT c_custkey AS source, header, list_filter(header, lambda c: c <> '') AS filled FROM ({_SQL_HEADERS})))))""",
)
def header_violations(spark, d):
    key = F.col("c_custkey")
    cells = F.array(
        F.lit("Id"), "c_mktsegment", F.when(key % 3 == 0, "").otherwise("Name (full)"),
        F.when(key % 5 == 0, "Id").otherwise(F.concat(F.lit("No. "), key)), F.when(key % 7 == 0, "--").otherwise("x"),
        F.when(key % 11 == 0, "name-full").otherwise("y"),
    )
    return schema.header_violations(table(spark, d, "customer").select(key.alias("source"), cells.alias("header")))


@query(
    "filter_violations",
    with_views(
        """SELECT DISTINCT 'nation' || c_nationkey AS source, 'cust_' || (c_custkey // 2 * 2) AS field FROM customer
           EXCEPT SELECT source, field FROM fields WHERE role = 'public'""",
        **_SCHEMA_SQL,
    ),
)
def filter_violations(spark, d):
    """Row filters on fields that their source does not publish."""
    filters = table(spark, d, "customer").select(
        F.concat(F.lit("nation"), "c_nationkey").alias("source"), F.concat(F.lit("cust_"), F.expr("c_custkey div 2 * 2")).alias("field")
    )
    return schema.filter_violations(filters, _fields(spark, d))


# One worksheet for each supplier: some lack a column, have one too many, one twice, or two in the wrong order.
_REVIEW_COLUMNS = [*candidates.EVIDENCE, *review.REVIEW]
_SQL_WORKSHEETS = f"""SELECT s_suppkey AS source, p AS position, ({_REVIEW_COLUMNS!r})[p + 1] AS name FROM supplier, (SELECT unnest(range({len(_REVIEW_COLUMNS)})) AS p)"""


@query(
    "review_column_violations",
    f"""SELECT source, name AS "column", 'missing' AS rule FROM ({_SQL_WORKSHEETS}) WHERE source % 5 = 0 AND position = source % {len(_REVIEW_COLUMNS)}
        UNION ALL SELECT s_suppkey, 'extra', 'unexpected' FROM supplier WHERE s_suppkey % 5 = 1
        UNION ALL SELECT s_suppkey, 'reviewer', 'repeated' FROM supplier WHERE s_suppkey % 5 = 2
        UNION ALL SELECT source, name, 'misplaced' FROM ({_SQL_WORKSHEETS}) WHERE source % 5 = 3 AND position < 2""",
)
def review_column_violations(spark, d):
    key, width = F.col("source"), len(_REVIEW_COLUMNS)
    names = F.array(*map(F.lit, _REVIEW_COLUMNS))
    whole = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.posexplode(names).alias("position", "column"))
    swapped = F.when((key % 5 == 3) & (F.col("position") < 2), 1 - F.col("position")).otherwise(F.col("position"))
    cut = whole.where((key % 5 != 0) | (F.col("position") != key % width)).withColumn("position", swapped)
    more = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.lit(width).alias("position")).where(key % 5 <= 2)
    more = more.where(key % 5 > 0).withColumn("column", F.when(key % 5 == 1, "extra").otherwise("reviewer"))
    return review.review_column_violations(cut.unionByName(more))


@query(
    "missing_fields",
    with_views(
        """SELECT DISTINCT source, field FROM fields WHERE role <> 'restricted'
           EXCEPT SELECT source, field FROM named""",
        **_SCHEMA_SQL,
    ),
)
def missing_fields(spark, d):
    return schema.missing_fields(_fields(spark, d), schema.catalog_fields(_catalog(spark, d)))


@query("classify_columns", with_views(f"SELECT source, position, field, {_CLASS} AS classification FROM flagged", **_SCHEMA_SQL))
def classify_columns(spark, d):
    named = schema.catalog_fields(_catalog(spark, d)).select("source", "position", "field")
    return schema.classify_columns(named, _fields(spark, d), _patterns(spark, d))


@query(
    "public_schema_gate",
    with_views(
        """SELECT source, field, 'not_allowlisted' AS rule FROM flagged WHERE NOT is_public
           UNION ALL SELECT source, field, 'restricted' FROM flagged WHERE is_restricted""",
        **_SCHEMA_SQL,
    ),
)
def public_schema_gate(spark, d):
    return schema.public_schema_violations(
        schema.catalog_fields(_catalog(spark, d)), _fields(spark, d), _patterns(spark, d)
    )


@query(
    "field_dictionary",
    with_views(
        f"""SELECT source, position, field, name AS display_name, data_type, {_CLASS} AS classification, description,
              true AS in_catalog FROM flagged
            UNION ALL SELECT source, -1, field, '', '', {_CLASS}, '', false FROM (
              SELECT m.*, EXISTS (SELECT 1 FROM fields f WHERE f.source = m.source AND f.field = m.field AND f.role = 'public') AS is_public,
                EXISTS (SELECT 1 FROM patterns p WHERE p.source = m.source AND contains(lower(m.field), lower(p.pattern))) AS is_restricted
              FROM (SELECT DISTINCT source, field FROM fields WHERE role <> 'restricted'
                    EXCEPT SELECT source, field FROM named) m)""",
        **_SCHEMA_SQL,
    ),
)
def field_dictionary(spark, d):
    made = schema.field_dictionary(_catalog(spark, d), _fields(spark, d), _patterns(spark, d))
    return made.fillna("", ["display_name", "data_type", "description"]).fillna(-1, ["position"])


# --- snapshots ------------------------------------------------------------------------------------


def _new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _written_csv(spark, d) -> str:
    """The documents as CSV files with quotes, blanks and line breaks inside cells."""
    path = _new_folder(spark, "csv")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("Doc ID"), F.col("text").alias("Text (full)"), F.col("lang").alias("lang"),
        F.when(F.col("doc_id") % 3 == 0, "")
        .otherwise(F.concat(F.lit('say "'), "source", F.lit('", ok'))).alias("Note"),
    )
    rows.write.csv(path, header=True, escape='"', emptyValue="")
    return path


_SQL_CSV = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS text_full, lang,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'say "' || source || '", ok' END AS note FROM documents"""


@query("scan_snapshot", _SQL_CSV)
def scan_snapshot(spark, d):
    scanned = snapshot.scan_snapshot(spark, _written_csv(spark, d))
    return scanned.withColumn("text_full", F.sha2("text_full", 256))


@query(
    "land_snapshot",
    "SELECT count(*) AS records, count(*) AS numbered, CAST(2 AS BIGINT) AS first_number, true AS gapless FROM documents",
)
def land_snapshot(spark, d):
    """Every file's records are numbered from 2 without gaps."""
    source = _written_csv(spark, d)
    landed = snapshot.land_snapshot(spark, source, source + "-landed")
    per_file = landed.groupBy(snapshot.FILE).agg(
        F.count("*").alias("n"), F.count_distinct("row_number").alias("k"), F.min("row_number").alias("lo"),
        F.max("row_number").alias("hi"),
    )
    return per_file.groupBy().agg(
        F.sum("n").alias("records"), F.sum("k").alias("numbered"), F.min("lo").alias("first_number"),
        F.bool_and(F.col("hi") - F.col("lo") + 1 == F.col("n")).alias("gapless"),
    )


# Orders as CSV files of 20,000 keys each, in the order of their keys. Every third note holds quotes, a comma and a line
# break; records of two keys in five lack the note or have a cell too many.
_ORDERS_A_FILE = 20_000


def _order_files(spark, d) -> str:
    path = _new_folder(spark, "orders")
    key = F.col("o_orderkey")
    part = F.floor(key / _ORDERS_A_FILE).cast("bigint").alias("part")
    note = F.when(key % 3 == 0, F.concat(F.lit('"say ""yes"",\n'), "o_orderstatus", F.lit('\n"'))).otherwise(F.col("o_orderstatus"))
    record = F.when(key % 5 == 2, F.concat_ws(",", key, "o_custkey")).when(
        key % 5 == 3, F.concat_ws(",", key, "o_custkey", note, F.lit(""))
    ).otherwise(F.concat_ws(",", key, "o_custkey", note))
    orders = table(spark, d, "orders").select(part, key.alias("key"), record.alias("value"))
    headers = orders.select("part", F.lit(-1).cast("bigint").alias("key"), F.lit("order,customer,note").alias("value")).distinct()
    lines = orders.unionByName(headers).repartition("part").sortWithinPartitions("part", "key")
    lines.select("part", "value").write.partitionBy("part").text(path)
    return path


def _part() -> Column:
    return F.regexp_extract(snapshot.FILE, "part=([0-9]+)", 1).cast("bigint").alias("part")


_SQL_ORDER_FILES = f"""SELECT o_orderkey // {_ORDERS_A_FILE} AS part, 1 + row_number() OVER
  (PARTITION BY o_orderkey // {_ORDERS_A_FILE} ORDER BY o_orderkey) AS row_number, * FROM orders"""


@query(
    "record_numbers",
    f"""SELECT part, row_number, CAST(o_orderkey AS VARCHAR) AS order_key, CAST(o_custkey AS VARCHAR) AS customer,
          CASE WHEN o_orderkey % 5 = 2 THEN '(none)' WHEN o_orderkey % 3 = 0 THEN 'say "yes",|' || o_orderstatus || '|' ELSE o_orderstatus END AS note
        FROM ({_SQL_ORDER_FILES})""",
)
def record_numbers(spark, d):
    """Every record with its number in its file, line breaks in cells or not."""
    numbered = snapshot.with_row_number(spark, _order_files(spark, d) + "/*")
    note = F.coalesce(F.replace("note", F.lit("\n"), F.lit("|")), F.lit("(none)"))
    return numbered.select(_part(), "row_number", F.col("order").alias("order_key"), "customer", note.alias("note"))


@query(
    "ragged_records",
    f"""SELECT part, row_number, CASE WHEN o_orderkey % 5 = 3 THEN 'long' ELSE 'short' END AS kind
        FROM ({_SQL_ORDER_FILES}) WHERE o_orderkey % 5 IN (2, 3)""",
)
def ragged_records(spark, d):
    """Every record whose cells are not as many as the header's."""
    return snapshot.ragged_records(spark, _order_files(spark, d) + "/*").select(_part(), "row_number", "kind")


@query(
    "public_projection",
    with_views("SELECT order_id, customer_id, status, total, ordered, priority FROM orders_snapshot", "orders_snapshot"),
)
def public_projection(spark, d):
    return schema.public_projection(T.orders_snapshot(spark, d), _REDACT)


# --- manifests and gates --------------------------------------------------------------------------
# Events are acquisitions: the user is the source, the event type tells the operation.

_SQL_MANIFESTS = """SELECT CAST(event_id AS VARCHAR) AS manifest, CASE WHEN event_id % 31 = 0 THEN 2 ELSE 1 END AS manifest_version,
  CASE event_type WHEN 'click' THEN 'acquire-csv' WHEN 'view' THEN 'acquire-csv' WHEN 'purchase' THEN 'freeze-metadata'
    WHEN 'signup' THEN 'freeze-metadata' ELSE 'delete' END AS operation,
  'user' || user_id AS source_slug, CASE WHEN event_id % 29 = 0 THEN 'other' ELSE 'ds-' || user_id END AS dataset_id,
  sha256(CAST(user_id AS VARCHAR) || '/' || event_type) AS content, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS retrieved_at,
  CASE WHEN event_id % 23 = 0 THEN 0 ELSE event_id + 1 END AS bytes, event_id, user_id, event_type FROM events"""
_SQL_LOCATED = """SELECT *, CASE WHEN event_id % 19 = 0 THEN substr(content, 1, 10) ELSE content END AS sha256,
  CASE WHEN event_id % 37 = 0 THEN 'data/../x/' || content || '.csv'
    WHEN event_id % 41 = 0 THEN '/data/raw/' || dataset_id || '/' || content || '.csv'
    WHEN operation = 'freeze-metadata' THEN 'data/metadata/ds-' || user_id || '/' || content || '.json'
    ELSE 'data/raw/ds-' || user_id || '/' || content || '.csv' END AS artifact FROM base"""
# The suppliers are the configured sources, so some users are unknown.
_SQL_SOURCES = """SELECT 'user' || s_suppkey AS source, 'ds-' || s_suppkey AS dataset_id, CAST(10 AS BIGINT) AS expected_minimum_rows
  FROM supplier"""
_MANIFEST_SQL = dict(base=_SQL_MANIFESTS, manifests=_SQL_LOCATED, sources=_SQL_SOURCES)


def _manifests(spark, d):
    key = F.col("event_id")
    content = F.sha2(F.concat_ws("/", "user_id", "event_type"), 256)
    operation = (
        F.when(F.col("event_type").isin("click", "view"), M.ACQUIRE)
        .when(F.col("event_type").isin("purchase", "signup"), M.FREEZE).otherwise("delete")
    )
    dataset = F.concat(F.lit("ds-"), "user_id")
    named = F.when(key % 29 == 0, "other").otherwise(dataset)
    artifact = (
        F.when(key % 37 == 0, F.concat(F.lit("data/../x/"), content, F.lit(".csv")))
        .when(key % 41 == 0, F.concat(F.lit("/data/raw/"), named, F.lit("/"), content, F.lit(".csv")))
        .when(operation == M.FREEZE, F.concat(F.lit("data/metadata/"), dataset, F.lit("/"), content, F.lit(".json")))
        .otherwise(F.concat(F.lit("data/raw/"), dataset, F.lit("/"), content, F.lit(".csv")))
    )
    return table(spark, d, "events").select(
        key.cast("string").alias("manifest"),
        F.when(key % 31 == 0, 2).otherwise(1).alias("manifest_version"),
        operation.alias("operation"),
        F.concat(F.lit("user"), "user_id").alias("source_slug"),
        named.alias("dataset_id"),
        artifact.alias("artifact"),
        F.struct(
            F.when(key % 23 == 0, F.lit(0)).otherwise(key + 1).alias("bytes"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("retrieved_at"),
            F.when(key % 19 == 0, F.substring(content, 1, 10)).otherwise(content).alias("sha256"),
        ).alias("receipt"),
    )


def _sources(spark, d):
    return table(spark, d, "supplier").select(
        F.concat(F.lit("user"), "s_suppkey").alias("source"), F.concat(F.lit("ds-"), "s_suppkey").alias("dataset_id"),
        F.lit(10).cast("bigint").alias("expected_minimum_rows"),
    )


_MANIFEST_RULES = (
    ("version", "manifest_version <> 1"),
    ("unknown_source", "expected IS NULL"),
    ("dataset_id", "expected IS NOT NULL AND dataset_id <> expected"),
    ("sha256", "length(sha256) <> 64"),
    ("bytes", "bytes <= 0"),
    ("artifact_path", "artifact LIKE '/%' OR artifact LIKE '%/../%'"),
    ("artifact_name", "regexp_extract(artifact, '([^/]*)\\.[a-z]+$', 1) <> sha256"),
    (
        "metadata_location",
        "operation = 'freeze-metadata' AND NOT coalesce(regexp_extract(artifact, '^(.*)/', 1) = 'data/metadata/' || expected AND artifact LIKE '%.json', false)",
    ),
    (
        "raw_location",
        "operation = 'acquire-csv' AND NOT coalesce(regexp_extract(artifact, '^(.*)/', 1) = 'data/raw/' || expected AND artifact LIKE '%.csv', false)",
    ),
    ("operation", "operation = 'delete'"),
)


@query(
    "manifest_violations",
    with_views(
        " UNION ALL ".join(f"SELECT manifest, '{rule}' AS rule FROM joined WHERE {where}" for rule, where in _MANIFEST_RULES),
        **_MANIFEST_SQL,
        joined="SELECT m.*, s.dataset_id AS expected FROM manifests m LEFT JOIN sources s ON s.source = m.source_slug",
    ),
)
def manifest_violations(spark, d):
    return gates.manifest_violations(_manifests(spark, d), _sources(spark, d)).drop("rule_position")


@query(
    "latest_artifacts",
    with_views(
        """SELECT source_slug AS source, operation, artifact, retrieved_at FROM (SELECT *, row_number() OVER
             (PARTITION BY source_slug, operation ORDER BY retrieved_at DESC, artifact DESC) AS n FROM manifests) WHERE n = 1""",
        **_MANIFEST_SQL,
    ),
)
def latest_artifacts(spark, d):
    return M.latest_artifacts(_manifests(spark, d))


@query(
    "snapshot_hash_as_of",
    with_views(
        """SELECT r.event_id, h.hash AS artifact_sha256
           FROM (SELECT * FROM manifests WHERE operation <> 'acquire-csv') r ASOF LEFT JOIN (
             SELECT source_slug, retrieved_at, max(regexp_extract(artifact, '([^/]*)\\.[a-z]+$', 1)) AS hash
             FROM manifests WHERE operation = 'acquire-csv' GROUP BY ALL
           ) h ON r.source_slug = h.source_slug AND r.retrieved_at >= h.retrieved_at""",
        **_MANIFEST_SQL,
    ),
)
def snapshot_hash_as_of(spark, d):
    """The hash of its source's newest snapshot at the time of every event that is not an acquisition."""
    manifests = _manifests(spark, d)
    rows = manifests.where(F.col("operation") != M.ACQUIRE).select(
        F.col("manifest").cast("bigint").alias("event_id"), F.col("source_slug").alias("source"), F.col("receipt.retrieved_at").alias("at")
    )
    return candidates.with_snapshot_hashes(rows, manifests, "source", "at").select("event_id", "artifact_sha256")


_SQL_STORED = """SELECT artifact, min(sha256) AS sha256, max(bytes) AS bytes FROM manifests WHERE event_type <> 'view' GROUP BY artifact"""


@query(
    "artifact_violations",
    with_views(
        """SELECT manifest, m.artifact, CASE WHEN s.sha256 IS NULL THEN 'missing' ELSE 'integrity_mismatch' END AS rule
           FROM manifests m LEFT JOIN stored s ON s.artifact = m.artifact
           WHERE s.sha256 IS NULL OR s.sha256 <> m.sha256 OR s.bytes <> m.bytes""",
        **_MANIFEST_SQL,
        stored=_SQL_STORED,
    ),
)
def artifact_violations(spark, d):
    manifests = _manifests(spark, d)
    # Raw files of "view" events were never stored.
    views = table(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").cast("string").alias("manifest"))
    stored = manifests.join(views, "manifest", "left_anti").groupBy("artifact").agg(
        F.min("receipt.sha256").alias("sha256"), F.max("receipt.bytes").alias("bytes")
    )
    return M.artifact_violations(manifests, stored)


# One stored file for each document. Some are missing, some have changed since their manifest was written.

def _stored_documents(spark, d) -> tuple[str, DataFrame]:
    """The folder of the files, and the documents with their artifact names."""
    root = _new_folder(spark, "artifacts")
    docs = table(spark, d, "documents").select(
        "doc_id", "text", F.concat(F.lit("data/raw/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("artifact")
    )
    content = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    kept = docs.where(F.col("doc_id") % 11 != 0).select("artifact", content.cast("binary").alias("content"))
    M.write_files(kept, root).write.format("noop").mode("overwrite").save()
    return root, docs


_SQL_FILES = """SELECT 'data/raw/' || source || '/' || doc_id || '.txt' AS artifact, doc_id, text,
  CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS content FROM documents"""


@query(
    "hash_files",
    f"""SELECT artifact, sha256(content) AS sha256, CAST(octet_length(encode(content)) AS BIGINT) AS bytes,
          strpos(content, chr(10)) > 0 AND strpos(split_part(content, chr(10), 1), ',') > 0 AS header_line
        FROM ({_SQL_FILES}) WHERE doc_id % 11 <> 0""",
)
def hash_files(spark, d):
    root, _ = _stored_documents(spark, d)
    hashed = M.hash_files(M.list_files(spark, root))
    return hashed.select(M.relative_path(F.col("path"), root).alias("artifact"), "sha256", "bytes", "header_line")


@query(
    "verify_artifacts",
    f"""SELECT CAST(doc_id AS VARCHAR) AS manifest, artifact,
          CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'integrity_mismatch' END AS rule FROM ({_SQL_FILES})
        WHERE doc_id % 11 = 0 OR sha256(content) <> sha256(text)""",
)
def verify_artifacts(spark, d):
    root, docs = _stored_documents(spark, d)
    receipt = F.struct(F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    manifests = docs.select(F.col("doc_id").cast("string").alias("manifest"), "artifact", receipt.alias("receipt"))
    return M.verify_artifacts(spark, manifests, root)


# One landed file for each document, below its source. One source is unknown; some files are empty or have no header.
_SQL_LANDED = """SELECT *, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'no header' WHEN 2 THEN 'id,note' || chr(10)
  ELSE repeat('x', 300) || ',lang' || chr(10) || doc_id || ',' || lang || chr(10) END AS content FROM documents"""
_UNKNOWN = "src3"


def _landed_content() -> Column:
    case = F.col("doc_id") % 5
    return (
        F.when(case == 0, "").when(case == 1, "no header").when(case == 2, "id,note\n")
        .otherwise(F.concat(F.lit("x" * 300 + ",lang\n"), "doc_id", F.lit(","), "lang", F.lit("\n")))
    )


def _landed(spark, d) -> tuple[str, DataFrame]:
    landing = _new_folder(spark, "landing")
    files = table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".csv")).alias("artifact"), _landed_content().cast("binary").alias("content")
    )
    M.write_files(files, landing).write.format("noop").mode("overwrite").save()
    known = table(spark, d, "documents").where(F.col("source") != _UNKNOWN).select("source").distinct()
    return landing, known.withColumn("dataset_id", F.concat(F.lit("ds-"), "source"))


@query(
    "register_snapshots",
    f"""SELECT source || '/' || doc_id || '.csv' AS file, 'acquire-csv' AS operation, source AS source_slug, 'ds-' || source AS dataset_id,
          'data/raw/ds-' || source || '/' || sha256(content) || '.csv' AS artifact, CAST(length(content) AS BIGINT) AS bytes,
          sha256(content) AS sha256
        FROM ({_SQL_LANDED}) WHERE doc_id % 5 > 1 AND source <> '{_UNKNOWN}'""",
)
def register_snapshots(spark, d):
    landing, sources = _landed(spark, d)
    files = M.list_files(spark, landing, "*.csv")
    registered = M.register_snapshots(M.hash_files(files).where("header_line"), files, sources)
    return registered.select(
        M.relative_path(F.col("path"), landing).alias("file"), "operation", "source_slug", "dataset_id", "artifact",
        "receipt.bytes", "receipt.sha256",
    )


@query(
    "landing_rejects",
    f"""SELECT source || '/' || doc_id || '.csv' AS file,
          CASE WHEN doc_id % 5 = 0 THEN 'empty' WHEN doc_id % 5 = 1 THEN 'no_csv_header' ELSE 'unknown_source' END AS rule
        FROM documents WHERE doc_id % 5 < 2 OR source = '{_UNKNOWN}'""",
)
def landing_rejects(spark, d):
    landing, sources = _landed(spark, d)
    files = M.list_files(spark, landing, "*.csv").unionByName(list_empty_files(spark, landing, ".csv"))
    rejects = M.landing_rejects(M.hash_files(files), sources)
    return rejects.select(M.relative_path(F.col("path"), landing).alias("file"), "rule")


@query(
    "snapshot_violations",
    """SELECT source || '/' || doc_id || '.csv' AS file, CASE doc_id % 5 WHEN 0 THEN 'empty' ELSE 'no_csv_header' END AS rule
       FROM documents WHERE doc_id % 5 < 2""",
)
def snapshot_violations(spark, d):
    landing, _ = _landed(spark, d)
    files = M.list_files(spark, landing, "*.csv").unionByName(list_empty_files(spark, landing, ".csv"))
    found = M.snapshot_violations(M.hash_files(files))
    return found.select(M.relative_path(F.col("path"), landing).alias("file"), "rule")


@query(
    "list_tree",
    f"""SELECT CASE WHEN doc_id % 5 = 4 THEN '' ELSE source || '/' END || doc_id || '.csv' AS file, CAST(length(content) AS BIGINT) AS bytes
        FROM ({_SQL_LANDED})""",
)
def list_tree_query(spark, d):
    """Every landed file, in the root and in the folders, with and without content."""
    landing, case = _new_folder(spark, "tree"), F.col("doc_id") % 5
    docs = table(spark, d, "documents").select(
        F.concat(F.when(case == 4, "").otherwise(F.concat("source", F.lit("/"))), "doc_id", F.lit(".csv")).alias("artifact"),
        _landed_content().cast("binary").alias("content"),
    )
    M.write_files(docs, landing).write.format("noop").mode("overwrite").save()
    return list_tree(spark, landing).select(M.relative_path(F.col("path"), landing).alias("file"), "bytes")


@query(
    "new_content",
    """SELECT artifact, min(path) AS path FROM (
         SELECT doc_id, 'data/raw/ds/' || sha256(text) || '.csv' AS artifact, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path FROM documents)
       WHERE artifact NOT IN (SELECT 'data/raw/ds/' || sha256(text) || '.csv' FROM documents WHERE doc_id % 3 = 0)
       GROUP BY artifact""",
)
def new_content(spark, d):
    """Of all texts as files of a batch, one for each content that an earlier batch has not stored, by the index."""
    artifact = F.concat(F.lit("data/raw/ds/"), F.sha2("text", 256), F.lit(".csv")).alias("artifact")
    batch = stage(table(spark, d, "documents").select("doc_id", artifact, F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path")), "batch")
    index = _new_folder(spark, "index")
    content_index.add_to_index(batch.where("doc_id % 3 = 0"), index, 0)
    return M.new_content(batch, content_index.stored_among(spark, batch, index))


# Frozen metadata: one document for each order, kept for its customer's dataset. The documents lie in a table of contents,
# many to a file; loose files, one for each customer, are read by the query below.
_SQL_FROZEN = """SELECT o_orderkey, 'user' || o_custkey AS source, 'data/metadata/ds-' || o_custkey || '/' || o_orderkey || '.json' AS artifact,
  '{"id":"' || CASE WHEN o_orderkey % 13 = 0 THEN 'other' ELSE 'ds-' || o_custkey END || '","name":"n' || o_orderkey || '"}' AS content FROM orders"""


@query(
    "frozen_metadata_violations",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS manifest, artifact, rule FROM (
          SELECT *, unnest(CASE WHEN o_orderkey % 7 = 0 THEN ['missing'] WHEN o_orderkey % 5 = 0 AND o_orderkey % 13 = 0
            THEN ['integrity_mismatch', 'other_dataset'] WHEN o_orderkey % 5 = 0 THEN ['integrity_mismatch']
            WHEN o_orderkey % 13 = 0 THEN ['other_dataset'] ELSE [] END) AS rule FROM ({_SQL_FROZEN}))""",
)
def frozen_metadata_violations(spark, d):
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.concat(F.lit("user"), "o_custkey").alias("source_slug"),
        F.concat(F.lit("data/metadata/ds-"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".json")).alias("artifact"),
        F.to_json(
            F.struct(
                F.when(key % 13 == 0, "other").otherwise(F.concat(F.lit("ds-"), "o_custkey")).alias("id"),
                F.concat(F.lit("n"), "o_orderkey").alias("name"),
            )
        ).alias("content"),
    )
    stored = stage(orders.where(key % 7 != 0).select("artifact", F.col("content").cast("binary").alias("content")), "frozen_documents")
    size = F.octet_length("content") + F.when(key % 5 == 0, 1).otherwise(0)
    manifests = orders.select(
        key.cast("string").alias("manifest"), F.lit(M.FREEZE).alias("operation"), "source_slug", "artifact",
        F.struct(size.cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256")).alias("receipt"),
    )
    sources = orders.select(F.col("source_slug").alias("source"), F.concat(F.lit("ds-"), "o_custkey").alias("dataset_id")).distinct()
    return M.document_violations(manifests, M.describe_documents(stored), sources)


# Frozen metadata over all orders: one document for each customer, made from all of the customer's orders, and one
# manifest for each order. (One file for each order did not end within 200 s on 150,000 orders.)
@query(
    "frozen_metadata_violations_all",
    """SELECT CAST(o_orderkey AS VARCHAR) AS manifest, 'data/metadata/ds-' || o_custkey || '.json' AS artifact, rule FROM (
          SELECT *, unnest(CASE WHEN o_custkey % 7 = 0 THEN ['missing'] WHEN o_orderkey % 5 = 0 AND o_custkey % 13 = 0
            THEN ['integrity_mismatch', 'other_dataset'] WHEN o_orderkey % 5 = 0 THEN ['integrity_mismatch']
            WHEN o_custkey % 13 = 0 THEN ['other_dataset'] ELSE [] END) AS rule FROM orders)""",
)
def frozen_metadata_violations_all(spark, d):
    root, key, customer = _new_folder(spark, "frozen"), F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    documents = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(key).alias("keys")).select(
        "o_custkey", F.concat(F.lit("data/metadata/ds-"), "o_custkey", F.lit(".json")).alias("artifact"),
        F.to_json(
            F.struct(
                F.when(customer % 13 == 0, "other").otherwise(F.concat(F.lit("ds-"), "o_custkey")).alias("id"),
                F.concat_ws("-", F.lit("orders"), "n", "keys").alias("name"),
            )
        ).alias("content"),
    )
    documents = stage(documents, "frozen_documents")
    M.write_files(documents.where(customer % 7 != 0).select("artifact", F.col("content").cast("binary").alias("content")), root).write.format(
        "noop"
    ).mode("overwrite").save()
    size = F.octet_length("content") + F.when(key % 5 == 0, 1).otherwise(0)
    source = F.concat(F.lit("user"), "o_custkey")
    manifests = orders.join(documents, "o_custkey").select(
        key.cast("string").alias("manifest"), F.lit(M.FREEZE).alias("operation"), source.alias("source_slug"), "artifact",
        F.struct(size.cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256")).alias("receipt"),
    )
    sources = documents.select(source.alias("source"), F.concat(F.lit("ds-"), "o_custkey").alias("dataset_id"))
    return M.frozen_metadata_violations(spark, manifests, root, sources)


# Orders are profile headers: one per order, of the customer's source.
_SQL_PROFILES = """SELECT 'p' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS profile_file, 'user' || (o_custkey % 70) AS source,
  CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 1 END AS profile_version,
  CASE WHEN o_orderkey % 29 = 0 THEN 'other' ELSE 'ds-' || (o_custkey % 70) END AS dataset_id,
  CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE o_orderkey % 20 END AS row_count,
  CAST(CASE WHEN o_orderkey % 19 = 0 THEN 11 ELSE 10 END AS BIGINT) AS expected_minimum_rows,
  o_orderkey % 20 >= 10 AS meets_expected_minimum,
  'data/raw/ds-' || (o_custkey % 70) || '/' || sha256((o_custkey % 70) || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'click' ELSE 'error' END) || '.csv' AS artifact
  FROM orders"""


def _profiles(spark, d):
    key, user = F.col("o_orderkey"), F.col("o_custkey") % 70
    kind = F.when(key % 2 == 0, "click").otherwise("error")
    dataset = F.concat(F.lit("ds-"), user)
    return table(spark, d, "orders").select(
        F.concat(F.lit("p"), F.lpad(key.cast("string"), 9, "0")).alias("profile_file"),
        F.concat(F.lit("user"), user).alias("source"),
        F.when(key % 31 == 0, 2).otherwise(1).alias("profile_version"),
        F.when(key % 29 == 0, "other").otherwise(dataset).alias("dataset_id"),
        F.when(key % 23 == 0, F.lit(-1)).otherwise(key % 20).cast("bigint").alias("row_count"),
        F.when(key % 19 == 0, 11).otherwise(10).cast("bigint").alias("expected_minimum_rows"),
        (key % 20 >= 10).alias("meets_expected_minimum"),
        F.concat(F.lit("data/raw/"), dataset, F.lit("/"), F.sha2(F.concat_ws("/", user, kind), 256), F.lit(".csv")).alias("artifact"),
    )


_PROFILE_RULES = (
    ("version", "profile_version <> 1"),
    ("unknown_source", "expected IS NULL"),
    ("dataset_id", "expected IS NOT NULL AND dataset_id <> expected"),
    ("row_floor", "expected IS NOT NULL AND expected_minimum_rows <> floor"),
    ("row_count", "row_count < 0"),
    ("floor_result", "expected IS NOT NULL AND meets_expected_minimum <> (row_count >= floor)"),
    ("artifact_without_manifest", "NOT EXISTS (SELECT 1 FROM manifests m WHERE m.operation = 'acquire-csv' AND m.source_slug = joined.source AND m.artifact = joined.artifact)"),
)
_PROFILE_JOINED = """SELECT p.*, s.dataset_id AS expected, s.expected_minimum_rows AS floor
  FROM profiles p LEFT JOIN sources s ON s.source = p.source"""


@query(
    "profile_violations",
    with_views(
        " UNION ALL ".join(f"SELECT profile_file, '{rule}' AS rule FROM joined WHERE {where}" for rule, where in _PROFILE_RULES),
        **_MANIFEST_SQL,
        profiles=_SQL_PROFILES,
        joined=_PROFILE_JOINED,
    ),
)
def profile_violations(spark, d):
    return gates.profile_violations(_profiles(spark, d), _sources(spark, d), _manifests(spark, d)).drop("rule_position")


@query(
    "latest_profiles",
    with_views(
        "SELECT source, max(profile_file) AS profile_file, max_by(row_count, profile_file) AS row_count FROM profiles GROUP BY source",
        profiles=_SQL_PROFILES,
    ),
)
def latest_profiles(spark, d):
    return M.latest_profiles(_profiles(spark, d)).select("source", "profile_file", "row_count")


@query(
    "coverage_violations",
    with_views(
        """SELECT source, 'no_metadata' AS rule FROM sources WHERE source NOT IN (SELECT source_slug FROM manifests WHERE operation = 'freeze-metadata')
           UNION ALL SELECT source, 'no_profile' FROM sources WHERE source NOT IN (SELECT source FROM profiles)
           UNION ALL SELECT source, 'no_fixture' FROM sources WHERE source NOT IN (SELECT 'user' || n_nationkey FROM nation)""",
        **_MANIFEST_SQL,
        profiles=_SQL_PROFILES,
    ),
)
def coverage_violations(spark, d):
    fixtures = table(spark, d, "nation").select(F.concat(F.lit("user"), "n_nationkey").alias("source"))
    return gates.coverage_violations(_sources(spark, d), _manifests(spark, d), _profiles(spark, d), fixtures)


@query(
    "gate_summary",
    with_views(
        """SELECT 'manifests' AS artifact_kind, count(*) AS checked FROM manifests
           UNION ALL SELECT 'metadata_artifacts', count(*) FROM manifests WHERE operation = 'freeze-metadata'
           UNION ALL SELECT 'profiles', count(*) FROM profiles UNION ALL SELECT 'fixtures', count(*) FROM supplier
           UNION ALL SELECT 'review_summaries', count(*) FROM nation""",
        **_MANIFEST_SQL,
        profiles=_SQL_PROFILES,
    ),
)
def gate_summary(spark, d):
    return gates.gate_summary(
        _manifests(spark, d), _profiles(spark, d), table(spark, d, "supplier"), table(spark, d, "nation")
    )


# --- review ---------------------------------------------------------------------------------------


@query(
    "row_fingerprint",
    """SELECT doc_id, sha256(CAST(to_json({'doc_id': CAST(doc_id AS VARCHAR), 'lang': lang, 'source': source, 'text': text}) AS VARCHAR))
       AS fingerprint FROM documents""",
)
def row_fingerprint(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", digests.row_fingerprint(["text", "source", "lang", "doc_id"]).alias("fingerprint")
    )


_ID = "substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16)"
_SQL_DOC_FP = f"SELECT doc_id, {_ID} AS id, sha256(lang || text) AS fp FROM documents"


def _doc_fp(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("id"),
        F.sha2(F.concat("lang", "text"), 256).alias("fp"),
    )


def _sql_set_digest(key: str, fingerprint: str, relation: str) -> str:
    return f"""SELECT sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS set_sha256 FROM (
      SELECT substr(sha256(k), 1, 4) AS bucket, sha256(string_agg(k || ':' || f, chr(10) ORDER BY k, f)) AS digest
      FROM (SELECT DISTINCT {key} AS k, {fingerprint} AS f FROM {relation}) GROUP BY 1)"""


@query("set_digest", _sql_set_digest("id", "fp", f"({_SQL_DOC_FP})"))
def set_digest(spark, d):
    return review.set_digest(_doc_fp(spark, d), "id", "fp")


# The labelled documents and the benchmark items were reviewed; low-quality ones have changed since.
_SQL_REVIEWED = f"""SELECT id, CASE WHEN quality = 0 THEN upper(fp) ELSE fp END AS fp FROM ({_SQL_DOC_FP}) JOIN labels USING (doc_id)
  UNION ALL SELECT substr(sha256('b' || item_id), 1, 16), sha256(text) FROM benchmark"""


@query(
    "candidate_drift",
    f"""SELECT coalesce(c.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'missing' WHEN c.id IS NULL THEN 'added' ELSE 'changed' END AS drift
        FROM ({_SQL_DOC_FP}) c FULL OUTER JOIN ({_SQL_REVIEWED}) r ON c.id = r.id
        WHERE c.id IS NULL OR r.id IS NULL OR c.fp <> r.fp""",
)
def candidate_drift(spark, d):
    current = _doc_fp(spark, d)
    labelled = current.join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", "id", F.when(F.col("quality") == 0, F.upper("fp")).otherwise(F.col("fp")).alias("fp")
    )
    items = table(spark, d, "benchmark").select(
        F.col("item_id").alias("doc_id"),
        F.substring(F.sha2(F.concat(F.lit("b"), "item_id"), 256), 1, 16).alias("id"),
        F.sha2("text", 256).alias("fp"),
    )
    current = current.select("id", F.col("fp").alias("_current"))
    reviewed = lay_out(labelled.unionByName(items), _new_folder(spark, "reviewed"), "id")
    return review.fingerprint_drift(current, reviewed, "id", "fp", "doc_id")


# Orders are review rows; statuses, decisions and mistakes come from their keys.
_CONSTANT = [
    c for c in candidates.EVIDENCE
    if c not in ("candidate_id", "evidence_tier", "public_record_source", "campaign_name", "campaign_rows")
]
_SQL_EVIDENCE = f"""SELECT o_orderkey + 2 AS row_number, o_orderkey,
  CASE WHEN o_orderkey % 97 = 0 THEN 'Bad' || o_orderkey WHEN o_orderkey % 89 = 0 THEN substr(sha256('7'), 1, 16)
    ELSE substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) END AS candidate_id,
  CASE WHEN o_orderstatus = 'F' THEN 'A_STRICT' ELSE 'B_LEGAL_SUFFIX' END AS evidence_tier,
  CASE o_orderkey % 3 WHEN 0 THEN 'echeckbook' WHEN 1 THEN 'contracts' ELSE 'purchase-orders' END AS public_record_source,
  'Customer ' || o_custkey AS campaign_name, CAST(o_custkey AS VARCHAR) AS campaign_rows,
  {", ".join(f"'{c} x' AS {c}" for c in _CONSTANT)} FROM orders"""
_SQL_FP = "sha256(CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in sorted(candidates.EVIDENCE)) + "}) AS VARCHAR))"
_REASON_OF = (
    "CASE WHEN o_orderkey % 10 = 9 THEN 'UNREVIEWED' WHEN o_orderkey % 53 = 0 THEN 'DONE' ELSE 'COMPLETE' END",
    "CASE WHEN o_orderkey % 10 = 9 THEN '' WHEN o_orderkey % 59 = 0 THEN 'MAYBE' ELSE "
    + sql_case("o_orderkey % 4", "'YES'", "' NO '", "'UNCERTAIN'", "'YES'") + " END",
    "CASE WHEN o_orderkey % 10 = 9 THEN '' WHEN o_orderkey % 61 = 0 THEN 'BECAUSE' ELSE "
    + sql_case("o_orderkey % 4", "'INDEPENDENT_OFFICIAL_IDENTITY'", "'DISTINCT_LEGAL_ENTITIES'", "'INSUFFICIENT_EVIDENCE'", "'SHARED_OFFICIAL_IDENTIFIER'") + " END",
    "CASE WHEN o_orderkey % 10 = 9 THEN '' WHEN o_orderkey % 67 = 0 THEN 'http://example.gov/a' ELSE 'https://example.gov/' || o_orderkey END",
    "CASE WHEN o_orderkey % 10 = 9 AND o_orderkey % 70 <> 9 THEN '' WHEN o_orderkey % 71 = 0 THEN ' ' ELSE 'checked' END",
    "CASE WHEN o_orderkey % 10 = 9 OR o_orderkey % 73 = 0 THEN '' ELSE 'reviewer' END",
    "CASE WHEN o_orderkey % 10 = 9 THEN '' WHEN o_orderkey % 79 = 0 THEN '2026-08-18' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '-05:00' END",
)
_SQL_REVIEW = f"""SELECT e.*, CASE WHEN o.o_orderkey % 83 = 0 THEN 'tampered' ELSE {_SQL_FP} END AS candidate_fingerprint,
  {", ".join(f"{sql.replace('o_orderkey', 'o.o_orderkey')} AS {c}" for sql, c in zip(_REASON_OF, review.REVIEW[1:]))}
  FROM evidence e JOIN orders o ON e.o_orderkey = o.o_orderkey"""
_REVIEW_SQL = dict(evidence=_SQL_EVIDENCE, review=_SQL_REVIEW)


def _review(spark, d):
    key = F.col("o_orderkey")
    open_row = key % 10 == 9
    evidence = {
        "candidate_id": F.when(key % 97 == 0, F.concat(F.lit("Bad"), key))
        .when(key % 89 == 0, F.substring(F.sha2(F.lit("7"), 256), 1, 16))
        .otherwise(F.substring(F.sha2(key.cast("string"), 256), 1, 16)),
        "evidence_tier": F.when(F.col("o_orderstatus") == "F", limits.STRICT).otherwise(limits.SUFFIX),
        "public_record_source": T._case(key % 3, F.lit("echeckbook"), F.lit("contracts"), F.lit("purchase-orders")),
        "campaign_name": F.concat(F.lit("Customer "), "o_custkey"),
        "campaign_rows": F.col("o_custkey").cast("string"),
        **{c: F.lit(f"{c} x") for c in _CONSTANT},
    }
    made = table(spark, d, "orders").select(
        (key + 2).alias("row_number"), "o_orderkey", "o_orderdate",
        *[evidence[c].alias(c) for c in candidates.EVIDENCE],
    )
    fingerprint = digests.row_fingerprint(candidates.EVIDENCE)
    decided = {
        "candidate_fingerprint": F.when(key % 83 == 0, "tampered").otherwise(fingerprint),
        "review_status": F.when(open_row, "UNREVIEWED").when(key % 53 == 0, "DONE").otherwise("COMPLETE"),
        "same_organization": F.when(open_row, "").when(key % 59 == 0, "MAYBE").otherwise(
            T._case(key % 4, F.lit("YES"), F.lit(" NO "), F.lit("UNCERTAIN"), F.lit("YES"))
        ),
        "review_reason": F.when(open_row, "").when(key % 61 == 0, "BECAUSE").otherwise(
            T._case(
                key % 4, F.lit("INDEPENDENT_OFFICIAL_IDENTITY"), F.lit("DISTINCT_LEGAL_ENTITIES"),
                F.lit("INSUFFICIENT_EVIDENCE"), F.lit("SHARED_OFFICIAL_IDENTIFIER"),
            )
        ),
        "external_evidence_url": F.when(open_row, "").when(key % 67 == 0, "http://example.gov/a")
        .otherwise(F.concat(F.lit("https://example.gov/"), key)),
        "review_notes": F.when(open_row & (key % 70 != 9), "").when(key % 71 == 0, " ").otherwise("checked"),
        "reviewer": F.when(open_row | (key % 73 == 0), "").otherwise("reviewer"),
        "reviewed_at": F.when(open_row, "").when(key % 79 == 0, "2026-08-18")
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))),
    }
    return made.select("row_number", *candidates.EVIDENCE, *[decided[c].alias(c) for c in review.REVIEW])


_DONE = "review_status = 'COMPLETE'"
_DECISION = "trim(same_organization)"
_ALLOWED = " OR ".join(f"({_DECISION} = '{k}' AND review_reason IN {v})" for k, v in review.REASONS.items())
_REVIEW_RULES = (
    ("candidate_id_shape", "NOT regexp_matches(candidate_id, '^[0-9a-f]{16}$')"),
    ("duplicate_candidate_id", "regexp_matches(candidate_id, '^[0-9a-f]{16}$') AND nth > 1"),
    ("evidence_changed", "candidate_fingerprint = 'tampered'"),
    ("partial_decision", "review_status = 'UNREVIEWED' AND trim(review_notes) <> ''"),
    ("review_status", "review_status = 'DONE'"),
    ("same_organization", f"{_DONE} AND {_DECISION} NOT IN ('YES', 'NO', 'UNCERTAIN')"),
    ("review_reason", f"{_DONE} AND {_DECISION} IN ('YES', 'NO', 'UNCERTAIN') AND NOT ({_ALLOWED})"),
    ("external_evidence_url", f"{_DONE} AND external_evidence_url NOT LIKE 'https://%'"),
    ("review_notes", f"{_DONE} AND trim(review_notes) = ''"),
    ("reviewer", f"{_DONE} AND reviewer = ''"),
    ("reviewed_at", f"{_DONE} AND reviewed_at NOT LIKE '%-05:00'"),
)
_SQL_BROKEN = " UNION ALL ".join(
    f"SELECT row_number, {i} AS rule_position, '{rule}' AS rule FROM numbered WHERE {where}"
    for i, (rule, where) in enumerate(_REVIEW_RULES)
)
_SQL_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY row_number) AS nth FROM review"


@query(
    "review_violations",
    with_views("SELECT row_number, CAST(rule_position AS BIGINT) AS rule_position, rule FROM broken", **_REVIEW_SQL, numbered=_SQL_NUMBERED, broken=_SQL_BROKEN),
)
def review_violations(spark, d):
    return review.review_violations(_review(spark, d)).withColumn("rule_position", F.col("rule_position").cast("bigint"))


@query(
    "first_violations",
    with_views(
        """SELECT row_number, rule, (SELECT count(*) FROM broken) - 25 AS remaining FROM broken
           ORDER BY row_number, rule_position LIMIT 25""",
        **_REVIEW_SQL, numbered=_SQL_NUMBERED, broken=_SQL_BROKEN,
    ),
)
def first_violations(spark, d):
    broken = review.review_violations(_review(spark, d))
    return checks.first_violations(broken, ["row_number", "rule_position"]).select("row_number", "rule", "remaining")


@query(
    "duplicate_ids",
    with_views("SELECT row_number, CAST(rule_position AS BIGINT) AS rule_position, rule FROM broken WHERE rule_position < 2", **_REVIEW_SQL, numbered=_SQL_NUMBERED, broken=_SQL_BROKEN),
)
def duplicate_ids(spark, d):
    """Malformed and repeated ids of a review table that lies by its ids."""
    laid_out = lay_out(_review(spark, d), _new_folder(spark, "review"), "candidate_id")
    return review.id_violations(laid_out, laid_out=True).withColumn("rule_position", F.col("rule_position").cast("bigint"))


@query(
    "init_review",
    with_views(
        f"""SELECT candidate_id, {_SQL_FP} AS candidate_fingerprint, 'UNREVIEWED' AS review_status, '' AS reviewed_at FROM evidence
            WHERE candidate_id NOT IN (SELECT candidate_id FROM evidence WHERE evidence_tier = 'A_STRICT')""",
        evidence=_SQL_EVIDENCE,
    ),
)
def init_review(spark, d):
    rows = _review(spark, d)
    existing = lay_out(rows.where(F.col("evidence_tier") == limits.STRICT), _new_folder(spark, "under-review"), "candidate_id")
    made = review.init_review(rows.select(*candidates.EVIDENCE), existing)
    return made.select("candidate_id", "candidate_fingerprint", "review_status", "reviewed_at")


@query(
    "review_totals",
    with_views(
        f"""SELECT count(*) AS candidates, count(DISTINCT candidate_id) FILTER ({_DONE}) AS reviewed,
            count(*) - count(DISTINCT candidate_id) FILTER ({_DONE}) AS unreviewed,
            count(*) = count(DISTINCT candidate_id) FILTER ({_DONE}) AS complete FROM review""",
        **_REVIEW_SQL,
    ),
)
def review_totals(spark, d):
    return review.review_totals(_review(spark, d))


@query(
    "decision_counts",
    with_views(
        "SELECT " + ", ".join(f"count(*) FILTER ({_DONE} AND {_DECISION} = '{x}') AS {x}" for x in review.DECISIONS) + " FROM review",
        **_REVIEW_SQL,
    ),
)
def decision_counts(spark, d):
    return review.decision_counts(_review(spark, d))


@query(
    "reason_counts",
    with_views(f"SELECT review_reason, count(*) AS rows FROM review WHERE {_DONE} GROUP BY review_reason", **_REVIEW_SQL),
)
def reason_counts(spark, d):
    return review.reason_counts(_review(spark, d))


_GROUP = "count(*) AS total, count(*) FILTER (" + _DONE + ") AS reviewed, " + ", ".join(
    f"count(*) FILTER ({_DONE} AND {_DECISION} = '{x}') AS {x}" for x in review.DECISIONS
)


@query(
    "group_report",
    with_views(
        f"""SELECT 'evidence_tiers' AS dimension, evidence_tier AS "group", {_GROUP} FROM review GROUP BY evidence_tier
            UNION ALL SELECT 'public_record_sources', public_record_source, {_GROUP} FROM review GROUP BY public_record_source""",
        **_REVIEW_SQL,
    ),
)
def group_report(spark, d):
    return review.group_report(_review(spark, d))


@query(
    "reviewed_through",
    with_views(
        f"""SELECT max(reviewed_at) FILTER ({_DONE}) AS reviewed_through FROM review""",
        **_REVIEW_SQL,
    ),
)
def reviewed_through(spark, d):
    return review.reviewed_through(_review(spark, d)).select("reviewed_through")


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(
    "review_summary",
    with_views(
        f"""SELECT CAST(1 AS BIGINT) AS review_summary_version, 'HUMAN' AS review_provenance,
              ({_sql_set_digest("candidate_id", "candidate_fingerprint", "review")}) AS candidate_set_sha256,
              count(*) AS candidates, count(*) FILTER ({_DONE} AND {_DECISION} = 'YES') AS yes,
              (SELECT string_agg(review_reason || '=' || n, ' | ' ORDER BY review_reason) FROM
                (SELECT review_reason, count(*) AS n FROM review WHERE {_DONE}
                   AND review_reason IN ({_listed(r for rs in review.REASONS.values() for r in rs)}) GROUP BY 1)) AS reasons,
              (SELECT string_agg(evidence_tier || '=' || n, ' | ' ORDER BY evidence_tier) FROM
                (SELECT evidence_tier, count(*) || '/' || count(*) FILTER ({_DONE} AND {_DECISION} = 'NO') AS n FROM review
                   WHERE evidence_tier IN ({_listed((limits.STRICT, limits.SUFFIX))}) GROUP BY 1)) AS tiers,
              (SELECT string_agg(public_record_source || '=' || n, ' | ' ORDER BY public_record_source) FROM
                (SELECT public_record_source, count(*) FILTER ({_DONE}) || '/' || count(*) FILTER ({_DONE} AND {_DECISION} = 'NO') AS n
                   FROM review WHERE public_record_source IN ({_listed(PUBLIC_SOURCES)}) GROUP BY 1)) AS sources,
              max(reviewed_at) FILTER ({_DONE}) AS reviewed_through
            FROM review""",
        **_REVIEW_SQL,
    ),
)
def review_summary(spark, d):
    one = review.review_summary(_review(spark, d), "HUMAN")

    def flat(name: str, value) -> Column:
        entries = F.array_sort(F.map_entries(name))
        return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], value(e["value"]))), SEPARATOR)

    def keyed(name: str, field: str) -> Column:
        keys = F.array_sort(F.map_keys(name))
        group = lambda k: F.concat_ws("/", F.col(name)[k][field], F.col(name)[k]["decisions"]["NO"])
        return F.array_join(F.transform(keys, lambda k: F.concat_ws("=", k, group(k))), SEPARATOR)

    return one.select(
        "review_summary_version", "review_provenance", "candidate_set_sha256",
        F.col("totals.candidates").alias("candidates"), F.col("decisions")["YES"].alias("yes"),
        flat("review_reasons", lambda v: v).alias("reasons"), keyed("evidence_tiers", "total").alias("tiers"),
        keyed("public_record_sources", "reviewed").alias("sources"), "reviewed_through",
    )


# One summary document per order, most of them wrong in one way: (rule, text replaced, replacement), N being a count.
_GROUP_TEXT = '{"total":N,"reviewed":N,"decisions":{"YES":N,"NO":0,"UNCERTAIN":0}}'
_SUMMARY_TEXT = (
    '{"review_summary_version":1,"review_provenance":"HUMAN","candidate_set_sha256":"' + "0123456789abcdef" * 4 + '","complete":true,'
    '"totals":{"candidates":N,"reviewed":N,"unreviewed":0},"decisions":{"YES":N,"NO":0,"UNCERTAIN":0},'
    '"review_reasons":{"SHARED_OFFICIAL_IDENTIFIER":N},"evidence_tiers":{"A_STRICT":' + _GROUP_TEXT + '},'
    '"public_record_sources":{"contracts":' + _GROUP_TEXT + '},"reviewed_through":"2026-08-18T14:30:00-05:00"}'
)
_REASON = '"SHARED_OFFICIAL_IDENTIFIER":N'
_TIER, _SOURCE = '"A_STRICT":' + _GROUP_TEXT, '"contracts":' + _GROUP_TEXT
_SUMMARY_CASES = (
    ("fields", '{"review_summary_version"', '{"note":1,"review_summary_version"'),
    ("version", 'version":1', 'version":2'),
    ("version", 'version":1', 'version":"1"'),
    ("version", 'version":1', 'version":1.0'),
    ("provenance", "HUMAN", "BOT"),
    ("digest", "0123456789abcdef", "0123456789ABCDEF"),
    ("complete", "true", "false"),
    ("complete", "true", '"true"'),
    ("total_fields", '"unreviewed":0', '"unreviewed":0,"left":0'),
    ("totals", '"unreviewed":0', '"unreviewed":1'),
    ("totals", '"unreviewed":0', '"unreviewed":"0"'),
    ("decision_fields", '0},"review_reasons"', '0,"MAYBE":0},"review_reasons"'),
    ("decisions", '"NO":0,"UNCERTAIN":0},"review_reasons"', '"NO":1,"UNCERTAIN":0},"review_reasons"'),
    ("decisions", '"NO":0,"UNCERTAIN":0},"review_reasons"', '"NO":"0","UNCERTAIN":0},"review_reasons"'),
    ("decisions", '"NO":0,"UNCERTAIN":0},"review_reasons"', '"NO":0.0,"UNCERTAIN":0},"review_reasons"'),
    ("known_reasons", _REASON, '"HEARSAY":N'),
    ("reasons", _REASON, '"SHARED_OFFICIAL_IDENTIFIER":1N'),
    ("reasons", _REASON, '"SHARED_OFFICIAL_IDENTIFIER":"N"'),
    ("evidence_tiers_groups", "A_STRICT", "C_OTHER"),
    ("evidence_tiers_counts", _TIER, '"A_STRICT":' + _GROUP_TEXT.replace('"reviewed":N', '"reviewed":0')),
    ("evidence_tiers_counts", _TIER, '"A_STRICT":' + _GROUP_TEXT.replace('"reviewed":N', '"reviewed":"N"')),
    ("evidence_tiers_counts", _TIER, '"A_STRICT":' + _GROUP_TEXT.replace("{", '{"more":1,', 1)),
    ("evidence_tiers_total", _TIER, '"A_STRICT":' + _GROUP_TEXT.replace("N,", "1N,")),
    ("public_record_sources_groups", "contracts", "minutes"),
    ("public_record_sources_counts", _SOURCE, '"contracts":' + _GROUP_TEXT.replace('"NO":0', '"NO":1')),
    ("public_record_sources_total", _SOURCE, _SOURCE + ',"echeckbook":' + _GROUP_TEXT),
    ("reviewed_through", "T14:30:00-05:00", ""),
)
_SUMMARY_KINDS = len(_SUMMARY_CASES) + 4  # the rest are good


def _summaries(spark, d):
    case = F.col("o_orderkey") % _SUMMARY_KINDS
    text = F.lit(_SUMMARY_TEXT)
    for i, (_, old, put) in enumerate(_SUMMARY_CASES):
        text = F.when(case == i, F.lit(_SUMMARY_TEXT.replace(old, put))).otherwise(text)
    # Counts are written where N stands alone as a number.
    count = (F.col("o_custkey") + 1).cast("string")
    counted = F.regexp_replace(text, F.lit(r"([:\d\x22])N(?=[,}\x22])"), F.concat(F.lit("$1"), count))
    return table(spark, d, "orders").select("o_orderkey", counted.alias("summary"))


@query(
    "summary_violations",
    f"SELECT o_orderkey, CASE o_orderkey % {_SUMMARY_KINDS} "
    + " ".join(f"WHEN {i} THEN '{rule}'" for i, (rule, _, _) in enumerate(_SUMMARY_CASES))
    + f" END AS rule FROM orders WHERE o_orderkey % {_SUMMARY_KINDS} < {len(_SUMMARY_CASES)}",
)
def summary_violations(spark, d):
    return review.summary_violations(_summaries(spark, d), "o_orderkey", "summary").drop("rule_position")


# --- round trips: what is written is read back through the library ----------------------------------

_FOLDERS = 256


def _folder_of(key: str) -> Column:
    """One of a fixed number of folders: files are made one after another in a folder, whatever the number of tasks."""
    return F.concat(F.pmod(F.xxhash64(key), F.lit(_FOLDERS)), F.lit("/"))


@query(
    "manifest_round_trip",
    with_views(
        "SELECT manifest || '.json' AS manifest, manifest_version, operation, source_slug, dataset_id, artifact, bytes, sha256, retrieved_at FROM manifests",
        **_MANIFEST_SQL,
    ),
)
def manifest_round_trip(spark, d):
    """One manifest document per event, written as files of their own, in folders that tasks can fill side by side."""
    path = _new_folder(spark, "manifests")
    made = _manifests(spark, d)
    document = F.to_json(F.struct(*[c for c in made.columns if c != "manifest"]))
    files = made.select(F.concat(_folder_of("manifest"), "manifest", F.lit(".json")).alias("artifact"), document.cast("binary").alias("content"))
    M.write_files(files, path).write.format("noop").mode("overwrite").save()
    return M.read_manifests(spark, path + "/*").select(
        "manifest", "manifest_version", "operation", "source_slug", "dataset_id", "artifact", "receipt.bytes", "receipt.sha256",
        "receipt.retrieved_at",
    )


@query(
    "catalog_round_trip",
    """SELECT 'ds' || o_custkey AS dataset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position,
         'Order ' || o_orderkey AS name, 'order_' || o_orderkey AS field_name, 'text' AS data_type, o_comment AS description
       FROM (SELECT o_orderkey, o_custkey, 'of ' || o_orderpriority AS o_comment FROM orders)""",
)
def catalog_round_trip(spark, d):
    """One metadata document per customer, with a column for each of its orders. They lie in folders as the manifests do."""
    path, key = _new_folder(spark, "metadata"), F.col("o_orderkey")
    column = F.struct(
        key.alias("k"), F.concat(F.lit("Order "), key).alias("name"), F.concat(F.lit("order_"), key).alias("fieldName"),
        F.lit("text").alias("dataTypeName"), F.concat(F.lit("of "), "o_orderpriority").alias("description"),
    )
    made = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    document = F.to_json(F.struct(F.concat(F.lit("ds"), "o_custkey").alias("id"), "columns"))
    files = made.select(F.concat(_folder_of("o_custkey"), "o_custkey", F.lit(".json")).alias("artifact"), document.cast("binary").alias("content"))
    M.write_files(files, path).write.format("noop").mode("overwrite").save()
    return read_column_catalog(spark, path + "/*").withColumn("position", F.col("position").cast("bigint"))


@query("profile_round_trip", ORACLE["profile_nulls"])
def profile_round_trip(spark, d):
    """Profiles of all sources in one table of JSON lines. A first try of each run is replaced by the second."""
    path = _new_folder(spark, "profiles")
    for df, contract in (
        (T.orders_snapshot(spark, d), T.ORDERS), (T.events_snapshot(spark, d), T.EVENTS), (T.lineitem_snapshot(spark, d), T.LINEITEM),
        (T.documents_snapshot(spark, d), T.DOCUMENTS), (T.conversations_snapshot(spark, d), T.CONVERSATIONS),
    ):
        made = profile.profile_fields(df, contract, T.AS_OF_YEAR)
        sinks.write_profile(made.limit(1), path, "r1", json=True)  # a run that broke off
        sinks.write_profile(made, path, "r1", json=True)
    return spark.read.json(path).select("source", "field", "rows", "nulls", "null_rate")


_FIXTURE_ROWS = 500


@query(
    "fixture_round_trip",
    f"SELECT * EXCLUDE row_number FROM ({ORACLE['redact_table']}) WHERE row_number <= {_FIXTURE_ROWS + 1}",
)
def fixture_round_trip(spark, d):
    """The first records, redacted, scanned, written as CSV and opened as a snapshot."""
    path = _new_folder(spark, "fixture")
    sinks.write_fixture(privacy.checked_fixture(T.orders_snapshot(spark, d), _REDACT, _FIXTURE_ROWS), _REDACT, path)
    return snapshot.scan_snapshot(spark, path)


@query("report_round_trip", ORACLE["group_report"])
def report_round_trip(spark, d):
    path = _new_folder(spark, "report")
    sinks.write_report(review.group_report(_review(spark, d)), path)
    return spark.read.json(path)


def _published_candidates(spark, d) -> str:
    """A worksheet that was published twice as one run, after a try that its own check refused."""
    path = _new_folder(spark, "worksheet")
    found = stage(_candidates(spark, d), "candidates")
    try:
        sinks.publish_candidates(found.unionByName(found), path, "r1", csv=True)
    except checks.GateError:
        pass
    for _ in range(2):
        sinks.publish_candidates(found, path, "r1", csv=True)
    return path


@query("candidates_round_trip", f"SELECT * EXCLUDE position FROM ({_CANDIDATES_SQL})")
def candidates_round_trip(spark, d):
    """The published worksheet, opened as a snapshot."""
    opened = snapshot.scan_snapshot(spark, _published_candidates(spark, d) + "/run=r1")
    amounts = {c: F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0)) for c in ("campaign_amount", "public_record_amount")}
    counts = ("campaign_rows", "public_record_rows", "campaign_keys_for_suffix", "public_keys_for_suffix")
    return opened.withColumns({**amounts, **{c: F.col(c).cast("bigint") for c in counts}})


@query("output_rows", f"SELECT count(*) AS rows FROM ({_CANDIDATES_SQL})")
def output_rows(spark, d):
    """The number of rows of a published output, counted while it was written."""
    return sinks.output_rows(spark, _published_candidates(spark, d))

