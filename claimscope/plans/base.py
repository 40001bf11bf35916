"""The claims table itself."""

from pyspark.sql import functions as F

from claimscope.functions.columns import joined
from claimscope.operators.routing import claim_codes, flatten, route, with_defaults
from claimscope.plans.claims_sql import over_claims
from claimscope.plans.registry import Registry
from claimscope.sources.tables import CLAIM_COLUMNS, claims, read_claims

registry = Registry()

_TABULAR = [c for c in CLAIM_COLUMNS if c != "note_id"]
_LISTS = ["red_flags", "procedure_codes", "diagnosis_codes"]


@registry.query(
    over_claims(
        "SELECT "
        + ", ".join(
            f"array_to_string({c}, '|') AS {c}" if c in _LISTS
            else f"{c}::DOUBLE AS {c}" if c == "billed_amount"
            else f"strftime({c}, '%Y-%m-%d %H:%M') AS {c}" if c == "submission_timestamp"
            else f"{c}::BIGINT AS {c}" if c in ("quantity", "days_supply")
            else c
            for c in _TABULAR
        )
        + " FROM claims"
    )
)
def claims_table(spark, sf_dir):
    rows = read_claims(spark, sf_dir, *_TABULAR)
    lists = {c: F.when(F.col(c).isNotNull(), joined(F.col(c))) for c in _LISTS}
    return rows.withColumns(
        {
            **lists,
            "billed_amount": F.col("billed_amount").cast("double"),
            "submission_timestamp": F.date_format("submission_timestamp", "yyyy-MM-dd HH:mm"),
            "quantity": F.col("quantity").cast("long"),
            "days_supply": F.col("days_supply").cast("long"),
        }
    )


@registry.query(
    over_claims(
        """SELECT claim_id, CASE WHEN claim_type IN ('professional', 'institutional') THEN 'medical'
        WHEN claim_type = 'pharmacy' THEN 'pharmacy'
        WHEN claim_type IN ('no_fault', 'auto') THEN 'no_fault' END AS claim_kind FROM claims"""
    )
)
def claim_routing(spark, sf_dir):
    return route(claims(spark, sf_dir, "claim_id", "claim_type")).select("claim_id", "claim_kind")


@registry.query(
    over_claims(
        """SELECT claim_id, patient_id, provider_id, provider_npi, date_of_service,
          billed_amount::DOUBLE AS billed_amount, claim_type, fraud_indicator,
          len(red_flags)::BIGINT AS red_flags_count,
          coalesce(length(text) > 0, false) AS has_notes,
          CASE WHEN kind = 'medical' THEN coalesce(len(diagnosis_codes), 0)::BIGINT END AS diagnosis_count,
          CASE WHEN kind = 'medical' THEN coalesce(len(procedure_codes), 0)::BIGINT END AS procedure_count,
          CASE WHEN kind = 'medical' THEN diagnosis_codes[1] END AS primary_diagnosis,
          CASE WHEN kind = 'medical' THEN procedure_codes[1] END AS primary_procedure,
          CASE WHEN kind = 'medical' THEN service_location END AS service_location,
          CASE WHEN kind = 'medical' THEN rendering_hours END AS rendering_hours,
          CASE WHEN kind = 'medical' THEN day_of_week END AS day_of_week,
          CASE WHEN kind = 'pharmacy' THEN quantity::BIGINT END AS quantity,
          CASE WHEN kind = 'pharmacy' THEN days_supply::BIGINT END AS days_supply,
          CASE WHEN kind = 'pharmacy' THEN fill_date END AS fill_date,
          CASE WHEN kind = 'no_fault' THEN accident_date END AS accident_date
        FROM (SELECT *, CASE WHEN claim_type IN ('professional', 'institutional') THEN 'medical'
                WHEN claim_type = 'pharmacy' THEN 'pharmacy' ELSE 'no_fault' END AS kind
              FROM claims LEFT JOIN documents
                ON doc_id = o_orderkey % (SELECT count(*) FROM documents))"""
    )
)
def claim_flattening(spark, sf_dir):
    return flatten(route(claims(spark, sf_dir)))


@registry.query(
    over_claims(
        """SELECT claim_id, provider_id, patient_id, date_of_service,
          coalesce(billed_amount, 0)::DOUBLE AS billed_amount,
          array_to_string(coalesce(procedure_codes, []), '|') AS procedure_codes,
          array_to_string(coalesce(diagnosis_codes, []), '|') AS diagnosis_codes FROM claims"""
    )
)
def claim_defaults(spark, sf_dir):
    rows = claims(
        spark, sf_dir, "claim_id", "provider_id", "patient_id", "date_of_service",
        "billed_amount", "procedure_codes", "diagnosis_codes",
    )
    return with_defaults(rows).withColumns(
        {
            "billed_amount": F.col("billed_amount").cast("double"),
            "procedure_codes": joined(F.col("procedure_codes")),
            "diagnosis_codes": joined(F.col("diagnosis_codes")),
        }
    )


@registry.query(
    over_claims(
        """SELECT claim_id, 'procedure' AS code_kind, unnest(procedure_codes) AS code FROM claims
        UNION ALL SELECT claim_id, 'diagnosis', unnest(diagnosis_codes) FROM claims"""
    )
)
def claim_code_rows(spark, sf_dir):
    return claim_codes(claims(spark, sf_dir, "claim_id", "procedure_codes", "diagnosis_codes"))
