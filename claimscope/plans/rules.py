"""Scored rule queries."""

from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.columns import joined, or_empty, rounded
from claimscope.operators import rules as R
from claimscope.plans.claims_sql import case_map, in_list, over_claims, quoted, text_list
from claimscope.plans.registry import Registry
from claimscope.sources.tables import claims

registry = Registry()

_PX = "coalesce(procedure_codes, [])"
_DX = "coalesce(diagnosis_codes, [])"


def _hits(words) -> str:
    return "list_filter(red_flags, lambda f: " + " OR ".join(f"contains(lower(f), {quoted(w)})" for w in words) + ")"


def _texts(found: str, prefix: str) -> str:
    return f"list_transform({found}, lambda f: {quoted(prefix)} || f)"


def _when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN [{text}] ELSE []::VARCHAR[] END"


_CONTEXT = [
    f"""prepared AS (SELECT *, {_PX} AS px, {_DX} AS dx,
      list_filter({_PX}, lambda c: c IN {in_list(K.HIGH_COMPLEXITY_PROCEDURES)}) AS complex_px,
      list_filter({_DX}, lambda c: c IN {in_list(K.SIMPLE_DIAGNOSES)}) AS simple_dx,
      list_transform({_PX}, lambda c: regexp_replace(c, '\\D', '', 'g')::BIGINT) AS numbers,
      list_has_any({_DX}, {text_list(K.ADEQUATE_DIAGNOSES)}) AS adequate,
      coalesce(list_sum(list_transform({_PX}, lambda c: {case_map("c", K.FEE_SCHEDULE, K.DEFAULT_FEE)})), 0)::BIGINT
        AS expected
      FROM claims)""",
    """overlap AS (SELECT a.claim_id, count(*) AS overlap_count FROM prepared a JOIN prepared b
      ON a.patient_id = b.patient_id AND a.provider_id = b.provider_id
      AND a.date_of_service = b.date_of_service AND a.claim_id <> b.claim_id
      WHERE list_has_any(a.px, b.px) GROUP BY 1)""",
    """dx_rows AS (SELECT claim_id, claim_type, unnest(dx) AS code FROM prepared)""",
    """auto_counts AS (SELECT code, count(*) AS n FROM dx_rows WHERE claim_type = 'auto' GROUP BY 1)""",
    """rare_autos AS (SELECT code, claim_id AS auto_claim FROM dx_rows JOIN auto_counts USING (code)
      WHERE claim_type = 'auto' AND n <= 3)""",
    """similar_claims AS (
      SELECT claim_id FROM dx_rows JOIN auto_counts USING (code) WHERE n > 3
      UNION SELECT claim_id FROM dx_rows JOIN rare_autos USING (code)
        GROUP BY claim_id HAVING count(DISTINCT auto_claim) > 3)""",
    """patient_order AS (SELECT claim_id, patient_id, coalesce(provider_id, '') AS p,
      row_number() OVER (PARTITION BY patient_id ORDER BY date_of_service, claim_id) AS place FROM claims)""",
    """shopping AS (SELECT a.claim_id, count(DISTINCT b.p) AS recent_providers FROM patient_order a
      JOIN patient_order b ON a.patient_id = b.patient_id AND b.place BETWEEN a.place - 29 AND a.place
      GROUP BY 1)""",
    """referral_counts AS (SELECT provider_id, referred_to_provider, count(*) AS n FROM prepared
      WHERE provider_id IS NOT NULL AND referred_to_provider IS NOT NULL
        AND len(list_filter(px, lambda c: contains(c, '99'))) > 0 GROUP BY 1, 2)""",
    """concentrations AS (SELECT provider_id, sum(n)::BIGINT AS referrals, max(n) / sum(n) AS concentration
      FROM referral_counts GROUP BY 1)""",
    """edges AS (SELECT DISTINCT provider_id AS src, referred_to_provider AS dst FROM claims
      WHERE provider_id IS NOT NULL AND referred_to_provider IS NOT NULL)""",
    """circles AS (SELECT DISTINCT a.src AS provider_id FROM edges a JOIN edges b
      ON a.src = b.dst AND a.dst = b.src)""",
]


def _today(limit_provider: int, limit_patient: int) -> str:
    return f"""today AS (SELECT claim_id,
      CASE WHEN provider_id IS NOT NULL THEN least(row_number() OVER (PARTITION BY provider_id, date_of_service
        ORDER BY claim_id), 100) END AS provider_today,
      least(row_number() OVER (PARTITION BY patient_id, date_of_service ORDER BY claim_id), 50) AS patient_today,
      {limit_provider} AS provider_limit, {limit_patient} AS patient_limit FROM claims)"""


def _rule_sql() -> dict[str, tuple[str, str]]:
    """rule -> (points, evidence list) over the prepared claims."""
    bundles = [
        (f"len(list_intersect(px, {text_list(codes)})) > 1", quoted(f"Multiple {name} procedures that should be bundled"))
        for name, codes in K.BUNDLES.items()
    ]
    patterns = " OR ".join(f"list_has_all(dx, {text_list(codes)})" for codes in K.STAGED_PATTERNS)
    concerned = f"(claim_type = 'auto' OR list_has_any(dx, {text_list(K.AUTO_INJURY_CODES)}))"
    progression = (
        "len(numbers) >= 2 AND len(list_distinct(numbers)) = len(numbers) "
        "AND list_max(numbers) - list_min(numbers) = len(numbers) - 1"
    )
    hour = "split_part(time_of_service, ':', 1)::INTEGER"
    weekend = "day_of_week IN ('Saturday', 'Sunday') AND service_location <> '23'"
    holiday = f"strftime(date_of_service, '%m-%d') IN {in_list(K.RULE_HOLIDAYS)}"
    odd_hour = f"({hour} < 6 OR {hour} > 22)"
    address = "list_filter(red_flags, lambda f: contains(lower(f), 'address') AND contains(lower(f), 'exist'))"
    controlled = f"list_filter(px, lambda c: c IN {in_list(K.CONTROLLED_CODES)} AND NOT adequate)"
    prescribed = f"len(list_filter(px, lambda c: c IN {in_list(K.PRESCRIPTION_CODES)}))"
    ghost = "(contains(patient_id, 'GHOST') OR coalesce(contains(provider_id, 'FRAUD'), false))"
    location = _hits(["appointment", "records", "closed"])
    staged = f"CASE WHEN {concerned} THEN {_hits(['relationship', 'prior', 'staged'])} ELSE [] END"
    kick = _hits(["kickback", "referral", "relationship"])

    def points(*terms) -> str:
        return " + ".join(f"{w} * ({c})::INTEGER" for w, c in terms)

    return {
        "upcoding_complexity": (
            f"30 * len(complex_px) * len(simple_dx) + "
            + points((40, "billed_amount > len(px) * 450"), (30, progression)),
            "list_concat(flatten(list_transform(complex_px, lambda p: list_transform(simple_dx, lambda d: "
            "'High complexity procedure ' || p || ' for simple diagnosis ' || d))), "
            + _when("billed_amount > len(px) * 450", "'Billed amount $' || billed_amount || ' excessive for procedures'")
            + ", " + _when(progression, quoted("Suspicious procedure code progression detected")) + ")",
        ),
        "phantom_billing_schedule": (
            points((40, weekend), (30, holiday), (50, odd_hour)) + f" + 60 * len({address})",
            "list_concat("
            + _when(weekend, "'Service on ' || day_of_week || ' for non-emergency location'") + ", "
            + _when(holiday, "'Service on holiday: ' || strftime(date_of_service, '%Y-%m-%d')") + ", "
            + _when(odd_hour, "'Service at ' || time_of_service || ' outside normal hours'") + ", "
            + f"list_transform({address}, lambda f: 'Patient address validation failed'))",
        ),
        "phantom_billing_location": (
            points((90, ghost)) + f" + 30 * len({location})",
            f"list_concat({_when(ghost, quoted('Ghost patient or fraudulent provider ID detected'))}, "
            f"{_texts(location, 'Location issue: ')})",
        ),
        "unbundling_detection": (
            points(*[(40, c) for c, _ in bundles], (30, "len(px) > 10")) + " + 50 * coalesce(overlap_count, 0)",
            "list_concat(" + ", ".join(_when(c, t) for c, t in bundles) + ", "
            + _when("coalesce(overlap_count, 0) > 0", "'Duplicate procedures across claims: ' || overlap_count || ' other claims'")
            + ", " + _when("len(px) > 10", "'Excessive procedures in single claim: ' || len(px)") + ")",
        ),
        "staged_accident_pattern": (
            points((40, f"{concerned} AND many_similar"), (30, f"{concerned} AND ({patterns})")) + f" + 50 * len({staged})",
            f"list_concat({_when(f'{concerned} AND many_similar', quoted('Multiple similar auto accidents'))}, "
            f"{_texts(staged, 'Staged accident indicator: ')}, "
            f"{_when(f'{concerned} AND ({patterns})', quoted('Consistent injury pattern across multiple claims'))})",
        ),
        "prescription_fraud_volume": (
            points((50, f"{prescribed} > 5"), (70, "recent_providers > 5")) + f" + 60 * len({controlled})",
            "list_concat("
            + _when(f"{prescribed} > 5", f"'Excessive prescription count: ' || {prescribed}") + ", "
            + f"list_transform({controlled}, lambda c: 'Controlled substance ' || c || ' without adequate diagnosis'), "
            f"{_when('recent_providers > 5', quoted('Doctor shopping pattern detected'))})",
        ),
        "kickback_referral_pattern": (
            points((40, "coalesce(concentration, 0) > 0.7"), (50, "circular")) + f" + 60 * len({kick})",
            "list_concat("
            + _when("coalesce(concentration, 0) > 0.7", "'High referral concentration: ' || printf('%.2f', concentration)")
            + f", {_when('circular', quoted('Circular referral pattern detected'))}, {_texts(kick, 'Kickback indicator: ')})",
        ),
        "billing_frequency_anomaly": (
            points((40, "coalesce(provider_today, 0) > provider_limit"), (30, "patient_today > patient_limit")),
            "list_concat("
            + _when("provider_today > provider_limit", "'Excessive daily claims: ' || provider_today") + ", "
            + _when("patient_today > patient_limit", "'Excessive patient visits: ' || patient_today") + ")",
        ),
        "amount_anomaly": (
            points(
                (50, "billed_amount > 10000"), (40, "expected > 0 AND billed_amount > expected * 2"),
                (20, "billed_amount % 100 = 0 AND billed_amount > 500"),
            ),
            "list_concat("
            + _when("billed_amount > 10000", "'Excessive claim amount: $' || billed_amount") + ", "
            + _when(
                "expected > 0 AND billed_amount > expected * 2",
                "'Amount $' || billed_amount || ' significantly exceeds expected $' || expected",
            ) + ", "
            + _when(
                "billed_amount % 100 = 0 AND billed_amount > 500",
                "'Suspiciously round billing amount: $' || billed_amount",
            ) + ")",
        ),
    }


def rule_tables(provider_limit: int = 50, patient_limit: int = 3, config: R.RuleConfig | None = None) -> list[str]:
    """CTEs ending in ``results(claim_id, rule_name, fraud_type, points, triggered, evidence, weight)``."""
    config = config or R.RuleConfig()
    joined_rows = """ctx AS (SELECT p.*, overlap_count, s.claim_id IS NOT NULL AS many_similar, recent_providers,
      concentration, c.provider_id IS NOT NULL AS circular, provider_today, patient_today, provider_limit, patient_limit
      FROM prepared p LEFT JOIN overlap USING (claim_id) LEFT JOIN similar_claims s ON s.claim_id = p.claim_id
      JOIN shopping sh ON sh.claim_id = p.claim_id
      LEFT JOIN concentrations k ON k.provider_id = p.provider_id
      LEFT JOIN circles c ON c.provider_id = p.provider_id JOIN today t ON t.claim_id = p.claim_id)"""
    selects = [
        f"SELECT claim_id, {quoted(name)} AS rule_name, {quoted(config.rules[name]['fraud_type'])} AS fraud_type, "
        f"points, points >= {R.points(config.rules[name]['threshold'])} AS triggered, evidence, "
        f"{R.points(config.rules[name]['weight'])} AS weight, {i} AS place "
        f"FROM (SELECT claim_id, {points} AS points, {evidence} AS evidence FROM ctx)"
        for i, (name, (points, evidence)) in enumerate(_rule_sql().items())
        if config.rules[name]["enabled"]
    ]
    return [*_CONTEXT, _today(provider_limit, patient_limit), joined_rows, "results AS (" + " UNION ALL ".join(selects) + ")"]


_LONG = """SELECT claim_id, rule_name, fraud_type, points / 100 AS score, triggered,
  array_to_string(evidence, '; ') AS evidence FROM results"""
# limits low enough to fire on these tables
_LOW = {"thresholds": {"max_daily_claims_per_provider": 1, "max_patient_visits_per_day": 1}}
_LOW_TABLES = rule_tables(1, 1)


def _long(rows):
    return rows.withColumn("evidence", joined(F.col("evidence"), "; "))


@registry.query(over_claims(_LONG, *rule_tables()))
def scored_rule_results(spark, sf_dir):
    return _long(R.rule_results(claims(spark, sf_dir, *R.RULE_COLUMNS)))


_RULE_INPUTS = {
    "upcoding_complexity": ["billed_amount", "procedure_codes", "diagnosis_codes"],
    "phantom_billing_schedule": [
        "date_of_service", "day_of_week", "time_of_service", "service_location", "red_flags",
    ],
    "phantom_billing_location": ["patient_id", "provider_id", "red_flags"],
    "unbundling_detection": ["patient_id", "provider_id", "date_of_service", "procedure_codes"],
    "staged_accident_pattern": ["claim_type", "diagnosis_codes", "red_flags"],
    "prescription_fraud_volume": [
        "patient_id", "provider_id", "date_of_service", "procedure_codes", "diagnosis_codes",
    ],
    "kickback_referral_pattern": ["provider_id", "referred_to_provider", "procedure_codes", "red_flags"],
    "billing_frequency_anomaly": ["patient_id", "provider_id", "date_of_service"],
    "amount_anomaly": ["billed_amount", "procedure_codes"],
}


def _one_rule(name):
    def query(spark, sf_dir):
        rows = claims(spark, sf_dir, "claim_id", *_RULE_INPUTS[name])
        return _long(R.rule_results(rows, R.RuleConfig().override(_LOW), [name]))

    return query


for _name in K.RULES:
    registry.add(
        f"rule_{_name}", _one_rule(_name),
        over_claims(f"{_LONG} WHERE rule_name = {quoted(_name)}", *_LOW_TABLES),
    )


@registry.query(
    over_claims(
        """SELECT claim_id, len(numbers) >= 2 AND len(list_distinct(numbers)) = len(numbers)
        AND list_max(numbers) - list_min(numbers) = len(numbers) - 1 AS progression FROM prepared""",
        _CONTEXT[0],
    )
)
def procedure_progression(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "procedure_codes")
    return rows.select("claim_id", R.is_progression(or_empty("procedure_codes")).alias("progression"))


@registry.query(
    over_claims(
        "SELECT claim_id, recent_providers, recent_providers > 5 AS shopping FROM shopping", *_CONTEXT[6:8]
    )
)
def doctor_shopping(spark, sf_dir):
    return R.doctor_shopping(claims(spark, sf_dir, "claim_id", "patient_id", "provider_id", "date_of_service"))


@registry.query(
    over_claims(
        "SELECT provider_id, referrals, round(concentration, 6) AS concentration FROM concentrations",
        _CONTEXT[0], *_CONTEXT[8:10],
    )
)
def referral_concentration(spark, sf_dir):
    rows = claims(spark, sf_dir, "provider_id", "referred_to_provider", "procedure_codes")
    return R.referral_concentration(rows).withColumn("concentration", rounded(F.col("concentration")))


@registry.query(over_claims("SELECT provider_id FROM circles", *_CONTEXT[10:12]))
def circular_referrals(spark, sf_dir):
    return R.circular_referrals(claims(spark, sf_dir, "provider_id", "referred_to_provider"))


@registry.query(
    over_claims(
        """SELECT claim_id,
        least(count(*) OVER (PARTITION BY provider_id, date_of_service ORDER BY claim_id
          ROWS UNBOUNDED PRECEDING), 100)::BIGINT AS provider_today
        FROM claims WHERE provider_id IS NOT NULL
        QUALIFY least(count(*) OVER (PARTITION BY provider_id, date_of_service ORDER BY claim_id
          ROWS UNBOUNDED PRECEDING), 100) > 1"""
    )
)
def provider_day_history(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "provider_id", "date_of_service")
    return R.crowded_positions(rows, "provider_id", 1, K.PROVIDER_HISTORY, "provider_today")


@registry.query(
    over_claims("SELECT claim_id, expected AS expected_amount FROM prepared", _CONTEXT[0])
)
def expected_amounts(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "procedure_codes")
    return rows.select("claim_id", R.expected_amount(or_empty("procedure_codes")).alias("expected_amount"))


@registry.query(
    over_claims(
        """SELECT claim_id, round(s, 6) AS rule_score, triggered_rules AS rules_triggered, evidence,
        CASE WHEN s < 0.3 THEN 'Low' WHEN s < 0.7 THEN 'Medium' ELSE 'High' END AS risk_band FROM (
          SELECT claim_id, sum(points * weight) / (100.0 * sum(weight)) AS s,
            count(*) FILTER (triggered) AS triggered_rules,
            array_to_string(flatten(coalesce(list(evidence ORDER BY place) FILTER (triggered), [])), '; ') AS evidence
          FROM results GROUP BY 1)""",
        *rule_tables(),
    )
)
def overall_rule_scores(spark, sf_dir):
    rows = R.rule_scores(claims(spark, sf_dir, *R.RULE_COLUMNS))
    return rows.withColumns(
        {"rule_score": rounded(F.col("rule_score")), "evidence": joined(F.col("evidence"), "; ")}
    )


OVERRIDES = {
    "rules": {
        "amount_anomaly": {"threshold": 0.4, "weight": 1.0},
        "phantom_billing_location": {"enabled": False},
        "upcoding_complexity": {"threshold": 0.3},
        "not_a_rule": {"threshold": 0.1},
    },
    **_LOW,
}


@registry.query(over_claims(_LONG, *rule_tables(1, 1, R.RuleConfig().override(OVERRIDES))))
def rule_overrides(spark, sf_dir):
    config = R.RuleConfig().override(OVERRIDES)
    return _long(R.rule_results(claims(spark, sf_dir, *R.RULE_COLUMNS), config))


_CATALOGUE = ", ".join(f"({quoted(n)}, {quoted(kind)})" for n, (kind, _, _) in K.RULES.items())


@registry.query(
    over_claims(
        """SELECT fraud_type, count(DISTINCT c.rule_name) AS total_rules, count(DISTINCT c.rule_name) AS enabled_rules,
        coalesce(any_value(hits), 0)::BIGINT AS hits
        FROM catalogue c LEFT JOIN (SELECT fraud_type, count(*) FILTER (triggered) AS hits FROM results GROUP BY 1)
        USING (fraud_type) GROUP BY 1""",
        *rule_tables(), f"catalogue AS (SELECT * FROM (VALUES {_CATALOGUE}) t(rule_name, fraud_type))",
    )
)
def rule_statistics(spark, sf_dir):
    return R.rule_statistics(claims(spark, sf_dir, *R.RULE_COLUMNS))
