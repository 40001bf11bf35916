"""Validation queries."""

from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.operators import validation as V
from claimscope.plans.claims_sql import over_claims, quoted, text_list
from claimscope.plans.registry import Registry
from claimscope.sources.tables import claims, table

registry = Registry()
AS_OF = "2000-06-30"

_MEDICAL = "claim_type IN ('professional', 'institutional')"
_PHARMACY = "claim_type = 'pharmacy'"
_NO_FAULT = "claim_type IN ('no_fault', 'auto')"

# rule -> (condition, message) in SQL
SCHEMA_SQL = {
    **{f"missing_{c}": (f"{c} IS NULL", quoted("is a required property")) for c in V.SCHEMA_REQUIRED},
    **{
        f"pattern_{c}": (f"NOT regexp_full_match({c}, '{p}')", f"{c} || ' does not match the pattern'")
        for c, p in (
            ("claim_id", r"CLM-\d{4}-[A-Z0-9]+"),
            ("patient_id", r"PAT-[A-Z0-9-]+"),
            ("provider_id", r"PRV-[A-Z0-9-]+"),
            ("provider_npi", r"\d{10}"),
        )
    },
    "empty_diagnosis_codes": ("len(diagnosis_codes) = 0", quoted("has no items")),
    "empty_procedure_codes": ("len(procedure_codes) = 0", quoted("has no items")),
    "negative_billed_amount": ("billed_amount < 0", quoted("is less than the minimum of 0")),
    "enum_claim_type": (
        "claim_type NOT IN ('professional', 'institutional')",
        "claim_type || ' is not one of the medical claim types'",
    ),
}

BUSINESS_SQL = {
    "amount_over_daily_maximum": (
        "billed_amount > 50000",
        "'Amount $' || billed_amount || ' exceeds daily maximum $50000.00'",
    ),
    "round_amount": (
        "billed_amount % 100 = 0 AND billed_amount >= 1000",
        quoted("Suspicious round number billing amount"),
    ),
    "future_service_date": (f"date_of_service > DATE '{AS_OF}'", quoted("Service date is in the future")),
    "old_service_date": (
        f"DATE '{AS_OF}' - date_of_service > 730", quoted("Service date is over 2 years old"),
    ),
    "sunday_service": (
        f"{_MEDICAL} AND dayname(date_of_service) = 'Sunday'", quoted("Professional service on Sunday"),
    ),
    "suspicious_npi": (
        "starts_with(provider_npi, '9999999')", quoted("Suspicious NPI pattern (starts with 9999999)"),
    ),
    "test_provider": (
        "contains(provider_id, 'FRAUD') OR contains(provider_id, 'TEST')",
        quoted("Test or fraud provider ID detected"),
    ),
    "too_many_procedures": (
        f"{_MEDICAL} AND len(procedure_codes) > 20", "'Too many procedure codes: ' || len(procedure_codes)",
    ),
    "many_procedures": (
        f"{_MEDICAL} AND len(procedure_codes) > 5", quoted("Potential unbundling - many procedure codes"),
    ),
    "emergency_code_for_routine_diagnosis": (
        f"{_MEDICAL} AND list_has_any(procedure_codes, {text_list(K.ER_CODES)})"
        " AND len(list_filter(diagnosis_codes, lambda d: d[1:3] IN ('Z00', 'Z01'))) > 0",
        quoted("Diagnosis codes may not match procedure codes"),
    ),
    "long_days_supply": (f"{_PHARMACY} AND days_supply > 90", quoted("Excessive days supply (>90 days)")),
    "large_quantity": (f"{_PHARMACY} AND quantity > 1000", quoted("Unusually high quantity")),
    "fill_date_differs": (
        f"{_PHARMACY} AND fill_date <> date_of_service", quoted("Fill date differs from service date"),
    ),
    "accident_after_service": (
        f"{_NO_FAULT} AND accident_date > date_of_service", quoted("Accident date is after service date"),
    ),
    "late_after_accident": (
        f"{_NO_FAULT} AND date_of_service - accident_date > 365",
        "'Service date is ' || (date_of_service - accident_date) || ' days after accident'",
    ),
}


def _findings_sql(rules, sqls) -> str:
    return " UNION ALL ".join(
        f"SELECT claim_id, {quoted(name)} AS rule, {quoted(rules[name].field)} AS field_name, "
        f"{message} AS error_message, {quoted(rules[name].severity)} AS severity "
        f"FROM claims WHERE {condition}"
        for name, (condition, message) in sqls.items()
    )


def _findings_query(rules):
    def query(spark, sf_dir):
        rows = claims(spark, sf_dir, *V.rule_columns(rules.values()))
        return V.row_findings(rows, rules, AS_OF)

    return query


# V1, V2: schema; V5-V11, V13-V20: business rules, one query each and all in one scan
registry.add(
    "schema_findings", _findings_query(V.SCHEMA_RULES), over_claims(_findings_sql(V.SCHEMA_RULES, SCHEMA_SQL))
)
_identifier_rules = {n: r for n, r in V.SCHEMA_RULES.items() if n.startswith("pattern_")}
registry.add(
    "identifier_patterns",
    _findings_query(_identifier_rules),
    over_claims(_findings_sql(V.SCHEMA_RULES, {n: SCHEMA_SQL[n] for n in _identifier_rules})),
)
registry.add(
    "business_findings",
    _findings_query(V.BUSINESS_RULES),
    over_claims(_findings_sql(V.BUSINESS_RULES, BUSINESS_SQL)),
)
for _name, _rule in V.BUSINESS_RULES.items():
    registry.add(
        f"validate_{_name}",
        _findings_query({_name: _rule}),
        over_claims(_findings_sql(V.BUSINESS_RULES, {_name: BUSINESS_SQL[_name]})),
    )


@registry.query(
    over_claims(
        "SELECT claim_id, count(*) AS violations, "
        "string_agg(field_name || ': ' || error_message, '; ' ORDER BY place) AS errors FROM ("
        + " UNION ALL ".join(
            f"SELECT claim_id, {i} AS place, {quoted(V.SCHEMA_RULES[n].field)} AS field_name, "
            f"{m} AS error_message FROM claims WHERE {c}"
            for i, (n, (c, m)) in enumerate((n, SCHEMA_SQL[n]) for n in V.SCHEMA_RULES)
        )
        + ") GROUP BY claim_id"
    )
)
def schema_violation_lists(spark, sf_dir):
    return V.schema_violations(claims(spark, sf_dir, *V.rule_columns(V.SCHEMA_RULES.values())))


_FRAUD_TYPE = """CASE WHEN contains(provider_id, 'FRAUD') THEN 'phantom_billing'
  WHEN len(red_flags) > 0 THEN 'staged_accident' END"""


@registry.query(
    over_claims(
        f"""SELECT claim_id, 'fraud_type' AS field_name,
        'fraud_type is required when fraud_indicator is true' AS error_message, 'error' AS severity
        FROM (SELECT *, {_FRAUD_TYPE} AS fraud_type FROM claims) WHERE fraud_indicator AND fraud_type IS NULL"""
    )
)
def label_consistency(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "provider_id", "red_flags", "fraud_indicator")
    kind = F.when(F.col("provider_id").contains("FRAUD"), "phantom_billing").when(
        F.size("red_flags") > 0, "staged_accident"
    )
    return V.label_inconsistencies(rows.withColumn("fraud_type", kind))


_PHRASES = ", ".join(f"({quoted(f)}, {quoted(p)})" for f, g in K.FLAG_PHRASES.items() for p in g)


@registry.query(
    over_claims(
        """SELECT DISTINCT claim_id, family, 'red_flags' AS field_name,
        'Known fraud pattern detected: ' || phrase AS error_message, 'warning' AS severity
        FROM (SELECT claim_id, unnest(red_flags) AS flag FROM claims)
        JOIN phrases ON contains(lower(flag), lower(phrase))""",
        f"phrases AS (SELECT * FROM (VALUES {_PHRASES}) t(family, phrase))",
    )
)
def red_flag_phrases(spark, sf_dir):
    return V.flag_phrase_findings(claims(spark, sf_dir, "claim_id", "red_flags"))


@registry.query(
    """SELECT 'CLM-' || l_orderkey || '-' || l_linenumber AS claim_id, count(*) AS occurrences,
    'Duplicate claim ID found: CLM-' || l_orderkey || '-' || l_linenumber AS error_message,
    'error' AS severity FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
)
def duplicate_claim_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("CLM-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("claim_id")
    )
    return V.duplicate_claims(lines)


@registry.query(
    over_claims(
        """SELECT provider_id, date_of_service, count(*) AS claim_count,
        'Provider ' || provider_id || ' has ' || count(*) || ' claims on '
          || strftime(date_of_service, '%Y-%m-%d') AS error_message
        FROM claims WHERE provider_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""
    )
)
def busy_provider_days(spark, sf_dir):
    return V.busy_provider_days(claims(spark, sf_dir, "provider_id", "date_of_service"), limit=1)


@registry.query(
    over_claims(
        f"""SELECT (SELECT count(*) FROM claims) AS processed_count,
          ((SELECT count(*) FROM claims WHERE NOT fits)
           + (SELECT count(*) FROM found JOIN claims_fit USING (claim_id) WHERE severity = 'error')
           + (SELECT count(*) FROM (SELECT claim_id FROM claims GROUP BY 1 HAVING count(*) > 1)))::BIGINT
            AS error_count,
          ((SELECT count(*) FROM found JOIN claims_fit USING (claim_id) WHERE severity = 'warning')
           + (SELECT count(*) FROM (SELECT DISTINCT claim_id, phrase
                FROM (SELECT claim_id, unnest(red_flags) AS flag FROM claims_fit)
                JOIN phrases ON contains(lower(flag), lower(phrase))))
           + (SELECT count(*) FROM (SELECT provider_id, date_of_service FROM claims
                WHERE provider_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)))::BIGINT AS warnings_count
        """.replace("claims WHERE NOT fits", "claims WHERE claim_id NOT IN (SELECT claim_id FROM claims_fit)"),
        f"phrases AS (SELECT * FROM (VALUES {_PHRASES}) t(family, phrase))",
        f"claims_fit AS (SELECT * FROM claims WHERE NOT ({_MEDICAL}) "
        "OR (coalesce(len(diagnosis_codes), 0) > 0 AND coalesce(len(procedure_codes), 0) > 0))",
        f"found AS ({_findings_sql(V.BUSINESS_RULES, BUSINESS_SQL)})",
    )
)
def validation_batch_summary(spark, sf_dir):
    rules = V.BUSINESS_RULES
    columns = dict.fromkeys([*V.rule_columns(rules.values()), "patient_id", "red_flags"])
    return V.batch_summary(claims(spark, sf_dir, *columns), AS_OF, provider_day_limit=1)
