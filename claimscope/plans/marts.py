"""Queries of marts, rank fusion, configurable rules, drift and risk cards."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope import constants as K
from claimscope.functions.columns import rounded
from claimscope.operators import marts as A
from claimscope.plans.claims_sql import in_list, over_claims
from claimscope.plans.registry import Registry
from claimscope.plans.signals import over_enrichments
from claimscope.sources.enrichments import enrichments
from claimscope.sources.tables import claims, table

registry = Registry()


@registry.query(
    over_enrichments(
        """SELECT provider, field_name, round(sum(1 / (60 + rank)), 6) AS score FROM (
          SELECT provider, field_name, row_number() OVER (PARTITION BY provider ORDER BY n DESC, field_name) AS rank FROM s
          UNION ALL
          SELECT provider, field_name, row_number() OVER (PARTITION BY provider ORDER BY top DESC, field_name) FROM s)
        GROUP BY 1, 2""",
        "s AS (SELECT provider, field_name, count(*) AS n, max(latency_ms) AS top FROM enrichments GROUP BY 1, 2)",
    )
)
def reciprocal_rank_fusion(spark, sf_dir):
    s = enrichments(spark, sf_dir).groupBy("provider", "field_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("top")
    )

    def ranked(by):
        order = Window.partitionBy("provider").orderBy(F.desc(by), "field_name")
        return s.withColumn("rank", F.row_number().over(order))

    out = A.fuse_ranks([ranked("n"), ranked("top")], "provider", "field_name")
    return out.withColumn("score", rounded(F.col("score")))


@registry.query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_of_equal_texts(spark, sf_dir):
    return A.first_of_equal(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


_AGE = "regexp_extract(patient_id, '(\\d+)$', 1)::INTEGER % 90"


@registry.query(
    over_claims(
        f"""SELECT year(date_of_service) AS year, month(date_of_service) AS month, provider_specialty AS specialty,
        CASE WHEN {_AGE} < 18 THEN 'child' WHEN {_AGE} < 65 THEN 'adult' ELSE 'senior' END AS age_group,
        count(DISTINCT claim_id) AS claim_count, sum(billed_amount)::DOUBLE AS total_amount,
        count(*) FILTER (fraud_indicator) AS fraud_count,
        coalesce(sum(billed_amount) FILTER (fraud_indicator), 0)::DOUBLE AS fraud_amount FROM claims GROUP BY 1, 2, 3, 4"""
    )
)
def fraud_mart(spark, sf_dir):
    rows = claims(
        spark, sf_dir, "claim_id", "patient_id", "date_of_service", "provider_specialty", "billed_amount",
        "fraud_indicator",
    )
    age = F.regexp_extract("patient_id", r"(\d+)$", 1).cast("int") % 90
    group = F.when(age < 18, "child").when(age < 65, "adult").otherwise("senior")
    out = A.fraud_mart(rows.withColumn("age_group", group))
    return out.withColumns(
        {
            "year": F.col("year").cast("long"), "month": F.col("month").cast("long"),
            "total_amount": F.col("total_amount").cast("double"), "fraud_amount": F.col("fraud_amount").cast("double"),
        }
    )


@registry.query(
    over_claims(
        f"""SELECT strftime(d, '%Y%m%d')::BIGINT AS date_key, d AS full_date, year(d) AS year, quarter(d) AS quarter,
        month(d) AS month, weekofyear(d) AS week, (isodow(d) - 1)::BIGINT AS day_of_week, isodow(d) >= 6 AS is_weekend,
        strftime(d, '%m-%d') IN {in_list(K.FEATURE_HOLIDAYS)} AS is_holiday
        FROM (SELECT unnest(generate_series(min(date_of_service), max(date_of_service), INTERVAL 1 DAY))::DATE AS d
          FROM claims)"""
    )
)
def date_dimension(spark, sf_dir):
    out = A.date_dimension(claims(spark, sf_dir, "date_of_service"), "date_of_service")
    numbers = ("date_key", "year", "quarter", "month", "week", "day_of_week")
    return out.withColumns({c: F.col(c).cast("long") for c in numbers})


_YEAR = "date_of_service BETWEEN DATE '1999-06-30' AND DATE '2000-06-30'"


@registry.query(
    over_claims(
        f"""SELECT patient_id, kind, value, count(*) AS n FROM (
          SELECT patient_id, 'claims' AS kind, '' AS value FROM claims WHERE {_YEAR}
          UNION ALL SELECT patient_id, 'provider', provider_npi FROM claims WHERE {_YEAR} AND provider_npi IS NOT NULL
          UNION ALL SELECT patient_id, 'procedure', unnest(procedure_codes) FROM claims WHERE {_YEAR}) GROUP BY 1, 2, 3"""
    )
)
def patient_year_summary(spark, sf_dir):
    rows = claims(spark, sf_dir, "patient_id", "date_of_service", "provider_npi", "procedure_codes")
    return A.patient_year(rows, "2000-06-30")


PATTERNS = [
    A.Pattern(
        "large_emergency",
        (("billed_amount", "greater_than", 8000, 1.0), ("service_location", "equals", "23", 1.0)),
        "all",
    ),
    A.Pattern(
        "odd_provider",
        (("provider_id", "contains", "FRAUD", 1.0), ("provider_npi", "regex", "^9999999", 1.0)),
        "any",
    ),
    A.Pattern(
        "weekend_accident",
        (
            ("day_of_week", "in", ("Saturday", "Sunday"), 0.4),
            ("claim_type", "in", ("auto", "no_fault"), 0.4),
            ("billed_amount", "less_than", 1000, 0.2),
        ),
        "weighted_sum", 0.75,
    ),
    A.Pattern(
        "plain_office",
        (
            ("service_location", "not_equals", "23", 1.0),
            ("claim_type", "not_in", ("auto", "no_fault"), 1.0),
            ("day_of_week", "equals", "Monday", 1.0),
        ),
        "majority",
    ),
]


@registry.query(
    over_claims(
        """SELECT claim_id, 'large_emergency' AS pattern, 1.0::DOUBLE AS score FROM claims
          WHERE billed_amount > 8000 AND service_location = '23'
        UNION ALL SELECT claim_id, 'odd_provider', (contains(provider_id, 'FRAUD')::INTEGER
          + starts_with(provider_npi, '9999999')::INTEGER) / 2 FROM claims
          WHERE contains(provider_id, 'FRAUD') OR starts_with(provider_npi, '9999999')
        UNION ALL SELECT claim_id, 'weekend_accident', round(w, 6) FROM (SELECT claim_id,
            0.4 * (day_of_week IN ('Saturday', 'Sunday'))::INTEGER + 0.4 * (claim_type IN ('auto', 'no_fault'))::INTEGER
            + 0.2 * (billed_amount < 1000)::INTEGER AS w FROM claims) WHERE w >= 0.75
        UNION ALL SELECT claim_id, 'plain_office', round(n / 3, 6) FROM (SELECT claim_id, (service_location <> '23')::INTEGER
            + (claim_type NOT IN ('auto', 'no_fault'))::INTEGER + (day_of_week = 'Monday')::INTEGER AS n FROM claims)
          WHERE n >= 2"""
    )
)
def configured_patterns(spark, sf_dir):
    rows = claims(
        spark, sf_dir, "claim_id", "billed_amount", "service_location", "provider_id", "provider_npi",
        "day_of_week", "claim_type",
    )
    return A.pattern_matches(rows, PATTERNS).withColumn("score", rounded(F.col("score")))


_CURRENT = "date_of_service >= DATE '1998-01-01'"


def _samples(spark, sf_dir, column):
    rows = claims(spark, sf_dir, "date_of_service", column)
    return rows.withColumn("current", F.col("date_of_service") >= "1998-01-01")


@registry.query(
    over_claims(
        f"""SELECT round(max(abs(fa - fb)), 6) AS statistic FROM (
          SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM (
            SELECT billed_amount, count(*) FILTER (NOT {_CURRENT}) AS a, count(*) FILTER ({_CURRENT}) AS b
            FROM claims GROUP BY 1) WINDOW w AS (ORDER BY billed_amount))"""
    )
)
def amount_drift(spark, sf_dir):
    out = A.ks_statistic(_samples(spark, sf_dir, "billed_amount"), "billed_amount", "current")
    return out.select(rounded(F.col("statistic")).alias("statistic"))


@registry.query(
    over_claims(
        """SELECT round(sum((a - t * na / n) ** 2 / (t * na / n) + (b - t * nb / n) ** 2 / (t * nb / n)), 6) AS statistic,
        count(*) - 1 AS freedom FROM (SELECT a, b, a + b AS t, sum(a) OVER () AS na, sum(b) OVER () AS nb,
          sum(a + b) OVER () AS n FROM (SELECT claim_type, count(*) FILTER (NOT %s) AS a, count(*) FILTER (%s) AS b
            FROM claims GROUP BY 1))"""
        % (_CURRENT, _CURRENT)
    )
)
def claim_type_drift(spark, sf_dir):
    out = A.chi_square(_samples(spark, sf_dir, "claim_type"), "claim_type", "current")
    return out.withColumn("statistic", rounded(F.col("statistic")))


@registry.query(
    over_claims(
        """SELECT provider_id, provider_specialty, round(avg_daily_claims, 6) AS avg_daily_claims, avg_claim_amount,
        round(m, 4) AS specialty_avg, round((rank() OVER (PARTITION BY provider_specialty ORDER BY avg_claim_amount)
          + (count(*) OVER (PARTITION BY provider_specialty, avg_claim_amount) - 1) / 2)
          / count(*) OVER (PARTITION BY provider_specialty), 6) AS percentile_rank,
        round(CASE WHEN s > 0 THEN (avg_claim_amount - m) / s ELSE 0 END, 6) AS standard_deviations FROM (
          SELECT *, avg(avg_claim_amount) OVER w AS m, stddev_samp(avg_claim_amount) OVER w AS s FROM (
            SELECT provider_id, provider_specialty, count(*) / count(DISTINCT date_of_service) AS avg_daily_claims,
              sum(billed_amount)::DOUBLE / count(*) AS avg_claim_amount
            FROM claims WHERE provider_id IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY provider_specialty))"""
    )
)
def provider_risk_cards(spark, sf_dir):
    rows = claims(spark, sf_dir, "provider_id", "provider_specialty", "date_of_service", "billed_amount")
    return A.provider_risk_cards(rows).withColumns(
        {
            "avg_daily_claims": rounded(F.col("avg_daily_claims")), "specialty_avg": rounded(F.col("specialty_avg"), 4),
            "percentile_rank": rounded(F.col("percentile_rank")),
            "standard_deviations": rounded(F.col("standard_deviations")),
        }
    )


@registry.query(
    over_claims(
        """SELECT claim_id, patient_id, (due - fill_date)::BIGINT AS days_early FROM (
          SELECT claim_id, patient_id, fill_date, lag(fill_date + days_supply) OVER (PARTITION BY patient_id
            ORDER BY fill_date, claim_id) AS due FROM claims WHERE fill_date IS NOT NULL) WHERE due - fill_date >= 5"""
    )
)
def early_refills(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "patient_id", "fill_date", "days_supply")
    return A.early_refills(rows.where("fill_date IS NOT NULL"))


@registry.query(
    over_claims(
        """SELECT a.claim_id, count(DISTINCT b.provider_npi) AS prescribers FROM claims a JOIN claims b
        ON a.patient_id = b.patient_id AND b.date_of_service BETWEEN a.date_of_service - 30 AND a.date_of_service
        GROUP BY 1 HAVING count(DISTINCT b.provider_npi) > 1"""
    )
)
def prescribers_in_30_days(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "patient_id", "date_of_service", "provider_npi")
    return A.crowded_prescribers(rows, "provider_npi", more_than=1)


@registry.query(
    over_claims(
        """SELECT a.claim_id, count(DISTINCT b.provider_npi) AS pharmacies FROM fills a JOIN fills b
        ON a.patient_id = b.patient_id AND b.date_of_service BETWEEN a.date_of_service - 30 AND a.date_of_service
        GROUP BY 1 HAVING count(DISTINCT b.provider_npi) > 1""",
        "fills AS (SELECT claim_id, patient_id, date_of_service, provider_npi FROM claims WHERE claim_type = 'pharmacy')",
    )
)
def pharmacies_in_30_days(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "patient_id", "date_of_service", "provider_npi", "claim_type")
    return A.crowded_prescribers(rows.where("claim_type = 'pharmacy'"), "provider_npi", more_than=1, out="pharmacies")
