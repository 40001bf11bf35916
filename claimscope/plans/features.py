"""Feature queries."""

from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.columns import rounded
from claimscope.operators import features as X
from claimscope.operators import text as T
from claimscope.plans.claims_sql import case_map, in_list, over_claims, text_list
from claimscope.plans.registry import Registry
from claimscope.sources.tables import claims, spread, table

registry = Registry()

_N_PX = "coalesce(len(procedure_codes), 0)"
_N_DX = "coalesce(len(diagnosis_codes), 0)"


def _r(df, places=6, *columns):
    return df.withColumns({c: rounded(F.col(c), places) for c in columns})


_BASIC = f"""SELECT claim_id, billed_amount::DOUBLE AS billed_amount,
  round(ln(1 + billed_amount::DOUBLE), 6) AS billed_amount_log, round(sqrt(billed_amount::DOUBLE), 6) AS billed_amount_sqrt,
  {_N_PX}::BIGINT AS num_procedure_codes, {_N_DX}::BIGINT AS num_diagnosis_codes,
  ({_N_PX} + {_N_DX})::BIGINT AS total_codes,
  round(coalesce(list_avg(list_transform(procedure_codes, lambda c: {case_map("c", K.COMPLEXITY, 3)})), 0), 6)
    AS avg_procedure_complexity,
  round(coalesce(list_avg(list_transform(diagnosis_codes, lambda c: {case_map("c[1:3]", K.SEVERITY, 2)})), 0), 6)
    AS diagnosis_severity,
  round(billed_amount::DOUBLE / ({_N_PX} + 1), 6) AS amount_per_procedure, len(red_flags) AS num_red_flags FROM claims"""


def _basic(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "billed_amount", "procedure_codes", "diagnosis_codes", "red_flags")
    return _r(
        X.basic_features(rows), 6, "billed_amount_log", "billed_amount_sqrt", "avg_procedure_complexity",
        "diagnosis_severity", "amount_per_procedure",
    )


registry.add("basic_features", _basic, over_claims(_BASIC))


@registry.query(
    over_claims(
        f"""SELECT claim_id,
        round(coalesce(list_avg(list_transform(procedure_codes, lambda c: {case_map("c", K.COMPLEXITY, 3)})), 0), 6)
          AS avg_procedure_complexity FROM claims"""
    )
)
def procedure_complexity(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "procedure_codes")
    return rows.select("claim_id", rounded(X.procedure_complexity()).alias("avg_procedure_complexity"))


@registry.query(
    over_claims(
        f"""SELECT claim_id,
        round(coalesce(list_avg(list_transform(diagnosis_codes, lambda c: {case_map("c[1:3]", K.SEVERITY, 2)})), 0), 6)
          AS diagnosis_severity FROM claims"""
    )
)
def diagnosis_severity(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "diagnosis_codes")
    return rows.select("claim_id", rounded(X.diagnosis_severity()).alias("diagnosis_severity"))


def _coded(column):
    return f"""(SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS code FROM
      (SELECT DISTINCT {column} FROM claims WHERE {column} IS NOT NULL))"""


@registry.query(
    over_claims(
        f"""SELECT claim_id, l.code AS service_location_encoded, t.code AS claim_type_encoded,
        p.code AS provider_encoded, q.code AS patient_encoded FROM claims
        LEFT JOIN {_coded("service_location")} l USING (service_location)
        LEFT JOIN {_coded("claim_type")} t USING (claim_type)
        LEFT JOIN {_coded("provider_id")} p USING (provider_id)
        LEFT JOIN {_coded("patient_id")} q USING (patient_id)"""
    )
)
def entity_codes(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "service_location", "claim_type", "provider_id", "patient_id")
    return X.label_codes(rows)


_CALENDAR = f"""SELECT claim_id, year(date_of_service) AS year, month(date_of_service) AS month,
  day(date_of_service) AS day, (isodow(date_of_service) - 1)::BIGINT AS day_of_week,
  quarter(date_of_service) AS quarter, (isodow(date_of_service) >= 6)::BIGINT AS is_weekend,
  (strftime(date_of_service, '%m-%d') IN {in_list(K.FEATURE_HOLIDAYS)})::BIGINT AS is_holiday,
  (date_of_service - DATE '2020-01-01')::BIGINT AS days_since_epoch FROM claims"""


@registry.query(over_claims(_CALENDAR))
def calendar_features(spark, sf_dir):
    return X.calendar_features(claims(spark, sf_dir, "claim_id", "date_of_service"))


_PROVIDER_CALENDAR = """SELECT claim_id,
  CASE WHEN provider_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY provider_id, date_of_service) END::BIGINT
    AS provider_claims_same_day,
  CASE WHEN provider_id IS NULL THEN 0 ELSE
    round(avg((isodow(date_of_service) >= 6)::INTEGER) OVER (PARTITION BY provider_id), 6) END
    AS provider_weekend_ratio FROM claims"""


@registry.query(over_claims(_PROVIDER_CALENDAR))
def provider_calendar(spark, sf_dir):
    out = X.provider_calendar(claims(spark, sf_dir, "claim_id", "provider_id", "date_of_service"))
    return _r(out, 6, "provider_weekend_ratio")


_VISITS = """SELECT claim_id, count(*) OVER (PARTITION BY patient_id) AS patient_total_visits,
  providers AS patient_provider_diversity FROM claims JOIN
  (SELECT patient_id, count(DISTINCT provider_id) AS providers FROM claims GROUP BY 1) USING (patient_id)"""


@registry.query(over_claims(_VISITS))
def patient_visits(spark, sf_dir):
    return X.patient_visits(claims(spark, sf_dir, "claim_id", "patient_id", "provider_id"))


def _gap(key):
    return f"""CASE WHEN {key} IS NULL THEN NULL ELSE coalesce(date_of_service - lag(date_of_service)
      OVER (PARTITION BY {key} ORDER BY date_of_service, claim_id), 999) END::BIGINT"""


@registry.query(over_claims(f"SELECT claim_id, {_gap('patient_id')} AS days_since_last_visit FROM claims"))
def days_since_last_visit(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "patient_id", "date_of_service")
    return X.days_since_previous(rows, "patient_id", "days_since_last_visit")


_HOURS = """SELECT claim_id, split_part(time_of_service, ':', 1)::BIGINT AS hour_of_service,
  (split_part(time_of_service, ':', 1)::INTEGER < 7 OR split_part(time_of_service, ':', 1)::INTEGER > 19)::BIGINT
    AS is_after_hours, rendering_hours, round(ln(1 + rendering_hours), 6) AS rendering_hours_log FROM claims"""


@registry.query(over_claims(_HOURS))
def service_hours(spark, sf_dir):
    out = X.service_hours(claims(spark, sf_dir, "claim_id", "time_of_service", "rendering_hours"))
    return _r(out, 6, "rendering_hours_log")


_REFERRAL = f"""SELECT claim_id, is_referral, CASE WHEN provider_id IS NULL THEN 0 ELSE
  round(avg(is_referral) OVER (PARTITION BY provider_id), 6) END AS provider_referral_ratio
  FROM (SELECT claim_id, provider_id,
    coalesce(list_has_any(procedure_codes, {text_list(K.REFERRAL_CODES)}), false)::BIGINT AS is_referral FROM claims)"""


@registry.query(over_claims(_REFERRAL))
def referral_ratio(spark, sf_dir):
    out = X.referral_features(claims(spark, sf_dir, "claim_id", "provider_id", "procedure_codes"))
    return _r(out, 6, "provider_referral_ratio")


_POSITIONS = """SELECT claim_id,
  row_number() OVER (PARTITION BY patient_id ORDER BY date_of_service, claim_id) AS claim_sequence_position,
  CASE WHEN provider_id IS NOT NULL THEN
    row_number() OVER (PARTITION BY provider_id, date_of_service ORDER BY claim_id) END AS provider_daily_sequence
  FROM claims"""


@registry.query(over_claims(_POSITIONS))
def sequence_positions(spark, sf_dir):
    return X.sequence_positions(claims(spark, sf_dir, "claim_id", "patient_id", "provider_id", "date_of_service"))


@registry.query(
    over_claims(
        f"""SELECT claim_id, {_gap('patient_id')} AS days_between_patient_claims,
        {_gap('provider_id')} AS days_between_provider_claims FROM claims"""
    )
)
def claim_intervals(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "patient_id", "provider_id", "date_of_service")
    return X.combine(
        [
            X.days_since_previous(rows, "patient_id", "days_between_patient_claims"),
            X.days_since_previous(rows, "provider_id", "days_between_provider_claims"),
        ]
    )


@registry.query(
    over_claims(
        """SELECT patient_id, sum(switched)::BIGINT AS patient_provider_switches FROM (
          SELECT patient_id, coalesce(seen <> lag(seen) OVER (PARTITION BY patient_id
            ORDER BY date_of_service, claim_id), false)::INTEGER AS switched
          FROM (SELECT *, coalesce(provider_id, '') AS seen FROM claims)) GROUP BY 1"""
    )
)
def provider_switches(spark, sf_dir):
    return X.provider_switches(claims(spark, sf_dir, "claim_id", "patient_id", "provider_id", "date_of_service"))


def _stats(key, prefix):
    return f"""CASE WHEN {key} IS NULL THEN 0 ELSE sum(billed_amount) OVER (PARTITION BY {key})::DOUBLE
      / count(*) OVER (PARTITION BY {key}) END AS {prefix}_avg_amount,
    CASE WHEN {key} IS NULL THEN 0 ELSE coalesce(stddev_samp(billed_amount::DOUBLE) OVER (PARTITION BY {key}), 0) END
      AS {prefix}_std_amount,
    CASE WHEN {key} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {key}) END AS {prefix}_claim_count"""


_PROVIDER_STATS = f"""SELECT claim_id, provider_avg_amount,
  round(provider_std_amount, 4) AS provider_std_amount, provider_claim_count,
  CASE WHEN provider_claim_count > 1 THEN
    round((a - provider_avg_amount) / (provider_std_amount + 1e-8), 6) ELSE 0 END AS amount_zscore_provider
  FROM (SELECT claim_id, billed_amount::DOUBLE AS a, {_stats("provider_id", "provider")} FROM claims)"""


@registry.query(over_claims(_PROVIDER_STATS))
def provider_statistics(spark, sf_dir):
    out = X.provider_statistics(claims(spark, sf_dir, "claim_id", "provider_id", "billed_amount"))
    # a deviation of 0 divides by 1e-8 only, which is noise beyond comparing
    z = F.when(F.col("provider_claim_count") > 1, rounded(F.col("amount_zscore_provider"))).otherwise(0.0)
    return _r(out.withColumn("amount_zscore_provider", z), 4, "provider_std_amount")


_PATIENT_STATS = f"""SELECT claim_id, patient_avg_amount,
  round(patient_std_amount, 4) AS patient_std_amount, patient_claim_count
  FROM (SELECT claim_id, {_stats("patient_id", "patient")} FROM claims)"""


@registry.query(over_claims(_PATIENT_STATS))
def patient_statistics(spark, sf_dir):
    out = X.patient_statistics(claims(spark, sf_dir, "claim_id", "patient_id", "billed_amount"))
    return _r(out, 4, "patient_std_amount")


_IQR = """SELECT claim_id, (a < q1 - 1.5 * (q3 - q1) OR a > q3 + 1.5 * (q3 - q1))::BIGINT AS amount_anomaly_score
  FROM (SELECT claim_id, billed_amount::DOUBLE AS a FROM claims),
    (SELECT quantile_cont(billed_amount::DOUBLE, 0.25) AS q1, quantile_cont(billed_amount::DOUBLE, 0.75) AS q3
     FROM claims)"""


@registry.query(over_claims(_IQR))
def amount_iqr_outliers(spark, sf_dir):
    return X.iqr_outliers(claims(spark, sf_dir, "claim_id", "billed_amount"))


_RANKS = """SELECT claim_id, round((rank() OVER (ORDER BY billed_amount)
    + (count(*) OVER (PARTITION BY billed_amount) - 1) / 2) / count(*) OVER (), 6) AS amount_percentile,
  CASE WHEN provider_specialty IS NOT NULL THEN round((rank() OVER (PARTITION BY provider_specialty ORDER BY billed_amount)
    + (count(*) OVER (PARTITION BY provider_specialty, billed_amount) - 1) / 2)
    / count(*) OVER (PARTITION BY provider_specialty), 6) END AS amount_percentile_specialty FROM claims"""


@registry.query(over_claims(_RANKS))
def amount_percentile_ranks(spark, sf_dir):
    out = X.percentile_ranks(claims(spark, sf_dir, "claim_id", "billed_amount", "provider_specialty"))
    return _r(out, 6, "amount_percentile", "amount_percentile_specialty")


@registry.query(
    "SELECT doc_id, length(text) AS text_length, "
    "CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END::BIGINT AS word_count, "
    + ", ".join(f"contains(lower(text), '{k}')::BIGINT AS contains_{k}" for k in K.KEYWORDS)
    + " FROM documents"
)
def note_text_features(spark, sf_dir):
    notes = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("notes"))
    return T.text_features(notes, "doc_id")


STOP_WORDS = (
    "a about all also an and any are as at be been but by can could did do for from had has have he her his "
    "how if in into is it its may more no not of on one or our she so some than that the their them then "
    "there they this to was we were what when which who will with would you your"
).split()

_TFIDF = f"""WITH words AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda w: w NOT IN {in_list(STOP_WORDS)}) AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
terms AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
  FROM counts GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 100),
weighted AS (SELECT doc_id, term, tf * idf AS raw FROM counts JOIN terms USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted"""


@registry.query(_TFIDF)
def note_tfidf(spark, sf_dir):
    notes = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("notes"))
    return T.tfidf(notes, "doc_id", stop_words=STOP_WORDS).withColumn("weight", rounded(F.col("weight")))


@registry.query(
    over_claims(
        f"""SELECT * FROM ({_BASIC}) JOIN (SELECT claim_id, year, is_weekend, days_since_epoch FROM ({_CALENDAR}))
        USING (claim_id) JOIN ({_PROVIDER_CALENDAR}) USING (claim_id) JOIN ({_VISITS}) USING (claim_id)
        JOIN ({_REFERRAL}) USING (claim_id) JOIN ({_POSITIONS}) USING (claim_id) JOIN ({_PROVIDER_STATS}) USING (claim_id)
        JOIN ({_IQR}) USING (claim_id) JOIN ({_RANKS}) USING (claim_id)"""
    )
)
def combined_features(spark, sf_dir):
    rows = claims(
        spark, sf_dir, "claim_id", "patient_id", "provider_id", "date_of_service", "billed_amount",
        "procedure_codes", "diagnosis_codes", "red_flags", "provider_specialty",
    )
    calendar = X.calendar_features(rows).select("claim_id", "year", "is_weekend", "days_since_epoch")
    wide = X.combine(
        [
            X.basic_features(rows), calendar, X.provider_calendar(rows), X.patient_visits(rows),
            X.referral_features(rows), X.sequence_positions(rows), X.provider_statistics(rows),
            X.iqr_outliers(rows), X.percentile_ranks(rows),
        ]
    )
    z = F.when(F.col("provider_claim_count") > 1, rounded(F.col("amount_zscore_provider"))).otherwise(0.0)
    wide = _r(wide.withColumn("amount_zscore_provider", z), 4, "provider_std_amount")
    return _r(
        wide, 6, "billed_amount_log", "billed_amount_sqrt", "avg_procedure_complexity", "diagnosis_severity",
        "amount_per_procedure", "provider_weekend_ratio", "provider_referral_ratio",
        "amount_percentile", "amount_percentile_specialty",
    )


@registry.query()
def feature_table(spark, sf_dir):
    """Every feature family side by side."""
    return X.feature_table(claims(spark, sf_dir))
