"""Fraud signal queries."""

from claimscope.operators import missing as M
from claimscope.operators import signals as S
from claimscope.plans.claims_sql import over_claims
from claimscope.plans.missing import PROVIDER_PATTERN
from claimscope.plans.registry import Registry
from claimscope.sources.enrichments import enrichments
from claimscope.sources.tables import CLAIM_COLUMNS, claims

registry = Registry()

ENRICHMENTS = """enrichments AS (SELECT event_id AS enrichment_id, user_id AS provider, event_id % 997 AS claim,
  event_type AS field_name, ['patient', 'provider', 'medical_coding', 'regulatory'][event_id % 4 + 1] AS source,
  ts, k / 100 AS confidence, value AS latency_ms, value / 500 AS distance,
  (DATE '2024-12-31' - ts::DATE)::INTEGER AS age_days, k % 3 AS enriched_value, k % 4 AS fallback_count,
  k % 6 + 1 AS attempts, CASE WHEN k % 7 = 0 THEN 'default' ELSE 'pattern' END AS strategy,
  ['low', 'medium', 'high', 'critical'][k % 4 + 1] AS severity
  FROM (SELECT *, regexp_extract(props, '\\d+')::BIGINT AS k FROM events))"""


def over_enrichments(body: str, *tables: str) -> str:
    return "WITH " + ",\n".join([ENRICHMENTS, *tables]) + "\n" + body


def _one(name, strength, where="true"):
    return f"""SELECT enrichment_id::VARCHAR AS subject, '{name}' AS signal_type,
      round(({strength})::DOUBLE, 3) AS signal_strength FROM enrichments WHERE {where}"""


FAILURE = _one("enrichment_failure", "CASE WHEN confidence = 0 THEN 0.6 ELSE 0.5 END", "confidence < 0.5::DOUBLE")
LOW = _one("low_enrichment_confidence", "least(1, greatest(0, 0.6::DOUBLE - confidence) * 2)")
CODING = _one(
    "invalid_medical_combination",
    "CASE severity WHEN 'low' THEN 0.4 WHEN 'medium' THEN 0.6 WHEN 'high' THEN 0.8 ELSE 0.95 END",
)
COMPLEX = _one(
    "high_enrichment_complexity",
    """CASE WHEN strategy = 'default' THEN least(1, least(1, (attempts - 1) * 0.15) + 0.25)
       ELSE least(1, (attempts - 1) * 0.15) END""",
)
SOURCE = """SELECT enrichment_id::VARCHAR AS subject, 'unusual_enrichment_source' AS signal_type,
  round((CASE WHEN rate < 0.1::DOUBLE AND fallback_count > 0 THEN least(1, 0.5 + fallback_count * 0.1)
    WHEN fallback_count >= 3 THEN least(1, fallback_count * 0.15) ELSE 0.3 END)::DOUBLE, 3) AS signal_strength
  FROM (SELECT *, count(*) OVER (PARTITION BY provider, source) / count(*) OVER (PARTITION BY provider) AS rate
    FROM enrichments)"""


@registry.query(
    over_claims(
        """SELECT provider_npi AS subject, 'provider_incomplete_submissions' AS signal_type,
        round(CASE WHEN systematic_fields > 0 THEN least(1, least(1, missing_rate * 1.5) + systematic_fields * 0.1::DOUBLE)
          ELSE least(1, missing_rate * 1.5) END, 3) AS signal_strength FROM provider_patterns""",
        *PROVIDER_PATTERN,
    )
)
def signal_incomplete_submissions(spark, sf_dir):
    columns = [c for c in CLAIM_COLUMNS if c != "note_id"]
    return S.incomplete_submissions(M.provider_pattern(claims(spark, sf_dir, *columns)))


@registry.query(over_enrichments(FAILURE))
def signal_enrichment_failure(spark, sf_dir):
    return S.enrichment_failure(enrichments(spark, sf_dir), "enrichment_id")


@registry.query(over_enrichments(LOW))
def signal_low_confidence(spark, sf_dir):
    return S.low_confidence(enrichments(spark, sf_dir), "enrichment_id")


@registry.query(over_enrichments(CODING))
def signal_coding_violation(spark, sf_dir):
    return S.coding_violation(enrichments(spark, sf_dir), "enrichment_id")


@registry.query(
    over_claims(
        """SELECT c.claim_id AS subject, 'inconsistent_enrichment' AS signal_type,
        round((CASE WHEN share IS NULL THEN 0.4 ELSE least(1, share * 0.8) END)::DOUBLE, 3) AS signal_strength FROM claims c LEFT JOIN (
          SELECT claim_id, avg((seen / history < 0.1::DOUBLE)::INTEGER) AS share FROM coded
          JOIN (SELECT provider_id, code, count(*) AS seen FROM coded GROUP BY 1, 2) USING (provider_id, code)
          JOIN (SELECT provider_id, count(*) AS history FROM claims GROUP BY 1) USING (provider_id) GROUP BY 1) r
        ON r.claim_id = c.claim_id""",
        """coded AS (SELECT claim_id, provider_id, unnest(procedure_codes) AS code FROM claims
           WHERE provider_id IS NOT NULL)""",
    )
)
def signal_inconsistent_history(spark, sf_dir):
    return S.inconsistent_history(claims(spark, sf_dir, "claim_id", "provider_id", "procedure_codes"))


@registry.query(over_enrichments(SOURCE))
def signal_unusual_source(spark, sf_dir):
    return S.unusual_source(enrichments(spark, sf_dir), "enrichment_id")


@registry.query(over_enrichments(COMPLEX))
def signal_enrichment_complexity(spark, sf_dir):
    return S.enrichment_complexity(enrichments(spark, sf_dir), "enrichment_id")


@registry.query(
    over_enrichments(
        """SELECT subject, count(*) AS signal_count, max(signal_strength) AS max_strength,
        sum(signal_strength::DECIMAL(20,3))::DOUBLE / count(*) AS avg_strength,
        sum(signal_strength::DECIMAL(20,3))::DOUBLE AS total_strength,
        count(*) FILTER (signal_strength >= 0.7::DOUBLE) AS high_severity_count,
        string_agg(DISTINCT signal_type, '|' ORDER BY signal_type) AS signal_types FROM signals GROUP BY 1""",
        "signals AS (" + " UNION ALL ".join([FAILURE, LOW, CODING, SOURCE, COMPLEX]) + ")",
    )
)
def aggregated_signals(spark, sf_dir):
    rows = enrichments(spark, sf_dir)
    kinds = (S.enrichment_failure, S.low_confidence, S.coding_violation, S.unusual_source, S.enrichment_complexity)
    return S.aggregate_signals([kind(rows, "enrichment_id") for kind in kinds])
