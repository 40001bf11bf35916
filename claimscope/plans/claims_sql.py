"""The claims table in ANSI SQL, for the side-by-side check of every query."""

from __future__ import annotations

from claimscope.constants import CLAIM_TYPES, DIAGNOSIS_POOL, ORDER_FLAGS, PROCEDURE_POOL


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def case_map(expression: str, table: dict, default) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in table.items())
    return f"CASE {expression} {whens} ELSE {default} END"


_FLAGS = ", ".join(
    f"CASE WHEN o_orderkey % {n} = 0 THEN {quoted(t)} END" for n, t in ORDER_FLAGS.items()
)
_LINE_ORDER = "l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_shipdate"

CLAIMS = f"""
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS rn FROM lineitem
),
codes AS (
  SELECT l_orderkey,
    list_sort(list(DISTINCT {text_list(PROCEDURE_POOL)}[l_partkey % {len(PROCEDURE_POOL)} + 1])) AS px,
    list_sort(list(DISTINCT {text_list(DIAGNOSIS_POOL)}[(l_partkey + l_suppkey) % {len(DIAGNOSIS_POOL)} + 1])) AS dx
  FROM lineitem GROUP BY l_orderkey
),
claims AS (
  SELECT
    'CLM-' || year(o_orderdate) || '-' || lpad(o_orderkey::VARCHAR, 7, '0') AS claim_id,
    CASE WHEN o_orderkey % 997 = 0 THEN 'PAT-GHOST-' || o_custkey
         ELSE 'PAT-' || lpad(o_custkey::VARCHAR, 6, '0') END AS patient_id,
    o_orderdate::DATE AS date_of_service,
    (CASE WHEN o_orderkey % 25 = 0 THEN floor(o_totalprice / 4000) * 10000
          ELSE floor(o_totalprice * 2.5) END::BIGINT / 100.0)::DECIMAL(12,2) AS billed_amount,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '23' ELSE '11' END AS service_location,
    lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30' AS time_of_service,
    dayname(o_orderdate) AS day_of_week,
    list_filter([{_FLAGS}], lambda x: x IS NOT NULL) AS red_flags,
    o_orderdate + to_hours(o_orderkey % 72) AS submission_timestamp,
    o_orderdate::DATE - (o_orderkey % 500 - 5)::INTEGER AS accident_date,
    CASE WHEN l1.l_suppkey % 50 = 7 THEN 'PRV-FRAUD-' || l1.l_suppkey
         ELSE 'PRV-' || lpad(l1.l_suppkey::VARCHAR, 5, '0') END AS provider_id,
    CASE WHEN l1.l_suppkey % 50 = 7 THEN '9999999' || lpad((l1.l_suppkey % 1000)::VARCHAR, 3, '0')
         ELSE (1000000000 + l1.l_suppkey)::VARCHAR END AS provider_npi,
    (o_totalprice > 400000 OR coalesce(l1.l_suppkey % 50 = 7, false)) <> (o_orderkey % 29 = 0)
      AS fraud_indicator,
    l1.l_quantity / 10 AS rendering_hours,
    (l1.l_quantity * 40)::INTEGER AS quantity,
    l1.l_linenumber * 20 AS days_supply,
    l1.l_shipdate::DATE AS fill_date,
    px AS procedure_codes,
    dx AS diagnosis_codes,
    {case_map("c_mktsegment", {k: quoted(v) for k, v in CLAIM_TYPES.items()}, quoted("professional"))} AS claim_type,
    'PRV-' || lpad(l2.l_suppkey::VARCHAR, 5, '0') AS referred_to_provider,
    n_name AS provider_specialty,
    o_orderkey
  FROM orders
  LEFT JOIN (SELECT * FROM lines WHERE rn = 1) l1 ON l1.l_orderkey = o_orderkey
  LEFT JOIN (SELECT * FROM lines WHERE rn = 2) l2 ON l2.l_orderkey = o_orderkey
  LEFT JOIN codes ON codes.l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN supplier ON s_suppkey = l1.l_suppkey
  LEFT JOIN nation ON n_nationkey = s_nationkey
)"""


def over_claims(body: str, *tables: str) -> str:
    """A statement over ``claims`` and further named tables (``name AS (...)``)."""
    return "WITH " + ",\n".join([CLAIMS, *tables]) + "\n" + body
