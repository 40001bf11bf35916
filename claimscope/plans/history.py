"""Patient history and similarity queries."""

from pyspark.sql import functions as F

from claimscope.functions.columns import joined, rounded
from claimscope.operators import history as H
from claimscope.operators import similarity as Y
from claimscope.plans.claims_sql import over_claims
from claimscope.plans.registry import Registry
from claimscope.session import scratch_path
from claimscope.sources.tables import claims, table

registry = Registry()


@registry.query(
    over_claims(
        """SELECT patient_id, (place - 1) // 1000 AS page, count(*) AS claims_on_page,
        string_agg(claim_id || ' ' || strftime(date_of_service, '%Y-%m-%d') || ' ' || billed_amount, '; '
          ORDER BY place) AS claim_sequence
        FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date_of_service, claim_id) AS place
          FROM claims) GROUP BY 1, 2"""
    )
)
def patient_documents(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "patient_id", "date_of_service", "billed_amount")
    entry = F.transform(
        "claim_sequence",
        lambda e: F.concat(
            e["claim_id"], F.lit(" "), F.date_format(e["date_of_service"], "yyyy-MM-dd"), F.lit(" "),
            e["billed_amount"].cast("string"),
        ),
    )
    return H.history_documents(rows).select(
        "patient_id", "page", F.size("claim_sequence").cast("long").alias("claims_on_page"),
        joined(entry, "; ").alias("claim_sequence"),
    )


WINDOWS = """windows AS (SELECT patient_id,
  count(DISTINCT CASE WHEN latest - date_of_service <= 30 THEN provider_npi END) AS provider_count_30d,
  count(DISTINCT provider_npi) AS provider_count_90d,
  count(*) FILTER (latest - date_of_service <= 30) AS total_claims_30d, count(*) AS total_claims_90d,
  any_value(mean_amount) AS avg_claim_amount
  FROM claims JOIN (SELECT patient_id, max(date_of_service) AS latest,
    sum(billed_amount)::DOUBLE / count(*) AS mean_amount FROM claims GROUP BY 1) USING (patient_id)
  WHERE latest - date_of_service <= 90 GROUP BY 1)"""


def _window_rows(spark, sf_dir):
    return claims(spark, sf_dir, "patient_id", "provider_npi", "date_of_service", "billed_amount")


@registry.query(over_claims("SELECT * FROM windows", WINDOWS))
def patient_recent_windows(spark, sf_dir):
    return H.recent_windows(_window_rows(spark, sf_dir))


@registry.query(
    over_claims(
        """SELECT patient_id, round(count(DISTINCT code) / count(*), 6) AS diagnosis_diversity
        FROM (SELECT patient_id, unnest(diagnosis_codes) AS code FROM claims) GROUP BY 1"""
    )
)
def patient_diagnosis_diversity(spark, sf_dir):
    out = H.diagnosis_diversity(claims(spark, sf_dir, "patient_id", "diagnosis_codes"))
    return out.withColumn("diagnosis_diversity", rounded(F.col("diagnosis_diversity")))


RANGES = """ranges AS (SELECT patient_id, count(*) AS claim_count, min(date_of_service) AS date_range_start,
  max(date_of_service) AS date_range_end, CASE WHEN count(*) > 1 THEN
    (max(date_of_service) - min(date_of_service)) / (count(*) - 1) ELSE 0 END AS claim_frequency_days
  FROM claims GROUP BY 1)"""


@registry.query(over_claims("SELECT * FROM ranges", RANGES))
def patient_date_ranges(spark, sf_dir):
    return H.date_ranges(claims(spark, sf_dir, "patient_id", "date_of_service"))


@registry.query(
    over_claims(
        """SELECT patient_id, array_to_string(list_filter([
          CASE WHEN provider_count_30d >= 2 THEN 'Doctor shopping: ' || provider_count_30d || ' providers in 30 days' END,
          CASE WHEN controlled >= 1 THEN 'Excessive controlled substances: ' || controlled
            || ' prescriptions in 90 days' END], lambda x: x IS NOT NULL), '; ') AS red_flags
        FROM windows JOIN (SELECT patient_id, sum(coalesce(len(list_filter(procedure_codes,
            lambda c: c IN ('J2315', 'J1170', 'J2405'))), 0))::BIGINT AS controlled
          FROM claims JOIN (SELECT patient_id, max(date_of_service) AS latest FROM claims GROUP BY 1) USING (patient_id)
          WHERE latest - date_of_service <= 90 GROUP BY 1) USING (patient_id)""",
        WINDOWS,
    )
)
def patient_red_flags(spark, sf_dir):
    rows = claims(
        spark, sf_dir, "patient_id", "provider_npi", "date_of_service", "billed_amount", "procedure_codes"
    )
    patterns = H.recent_windows(rows).join(H.prescription_patterns(rows), "patient_id")
    flags = H.red_flags({"provider_count_30d": 2, "controlled_substance_prescriptions": 1})
    return H.with_absent_patterns(patterns).select("patient_id", joined(flags, "; ").alias("red_flags"))


def _top(column):
    return f"""(SELECT patient_id, string_agg(code, ', ' ORDER BY n DESC, code) AS codes FROM (
      SELECT patient_id, code, count(*) AS n FROM (SELECT patient_id, unnest({column}) AS code FROM claims)
      GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY count(*) DESC, code) <= 3)
      GROUP BY 1)"""


@registry.query(
    over_claims(
        f"""SELECT patient_id, 'Patient has ' || claim_count || ' claims. '
          || CASE WHEN provider_count_90d <> 1 THEN 'across ' || provider_count_90d || ' providers' ELSE 'with 1 provider' END
          || '. over ' || (date_range_end - date_range_start) || ' days'
          || coalesce('. Primary diagnoses: ' || d.codes, '') || coalesce('. Common procedures: ' || p.codes, '')
          || '. Average claim amount $' || round(avg_claim_amount::DECIMAL(18,6), 2)::DECIMAL(18,2) || '. '
          || CASE WHEN provider_count_30d >= 5 THEN 'Red flags: Doctor shopping: ' || provider_count_30d
               || ' providers in 30 days' ELSE 'No red flags detected' END || '.' AS narrative
        FROM ranges JOIN windows USING (patient_id) LEFT JOIN {_top("diagnosis_codes")} d USING (patient_id)
        LEFT JOIN {_top("procedure_codes")} p USING (patient_id)""",
        WINDOWS, RANGES,
    )
)
def patient_narratives(spark, sf_dir):
    return H.narratives(
        claims(
            spark, sf_dir, "patient_id", "provider_npi", "date_of_service", "billed_amount",
            "procedure_codes", "diagnosis_codes",
        )
    )


_CENTROIDS = """centroids AS (SELECT label, list(mean ORDER BY position) AS q FROM (
    SELECT label, position, avg(v::DOUBLE) AS mean FROM (SELECT label, unnest(embedding) AS v,
      generate_subscripts(embedding, 1) AS position FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
_SCORES = """SELECT c.label AS query_id, vec_id, list_dot_product(q, embedding::DOUBLE[])
    / sqrt(list_dot_product(q, q) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS score
  FROM centroids c, embeddings e"""


def _searched(found):
    return found.select("query_id", "vec_id", rounded(F.col("score")).alias("score"), F.col("rank").cast("long"))


def _top_sql(scores, threshold):
    return f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({scores})
      WHERE score >= {threshold}::DOUBLE) WHERE rank <= 10"""


@registry.query(f"WITH {_CENTROIDS} {_top_sql(_SCORES, 0.25)}")
def similarity_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = Y.centroids(vectors, "label", "embedding")
    return _searched(Y.search(vectors, queries, "vec_id", "embedding", k=10, threshold=0.25))


@registry.query(f"WITH {_CENTROIDS} {_top_sql(_SCORES + ' WHERE e.label = c.label', 0.0)}")
def filtered_similarity_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = Y.centroids(vectors, "label", "embedding")
    found = Y.search(vectors, queries, "vec_id", "embedding", k=10, threshold=0.0, payload="label")
    return _searched(found)


@registry.query(
    """SELECT vec_id, position, round(v / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS value
    FROM (SELECT vec_id, embedding, unnest(embedding)::DOUBLE AS v,
      generate_subscripts(embedding, 1) - 1 AS position FROM embeddings)"""
)
def unit_vectors(spark, sf_dir):
    rows = Y.normalised(table(spark, sf_dir, "embeddings"), "embedding")
    return rows.select("vec_id", F.posexplode("embedding").alias("position", "value")).select(
        "vec_id", F.col("position").cast("long"), rounded(F.col("value")).alias("value")
    )


@registry.query(
    """SELECT count(*) AS documents, min(len(embedding)) AS min_dimension, max(len(embedding)) AS max_dimension,
    count(*) > 0 AND min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS valid FROM embeddings"""
)
def collection_statistics(spark, sf_dir):
    return Y.collection_statistics(table(spark, sf_dir, "embeddings"), "embedding", 64)


@registry.query(
    over_claims(
        "SELECT claim_id, (('0x' || sha256(claim_id)[1:16])::UBIGINT)::VARCHAR AS point_id FROM claims"
    )
)
def stable_document_ids(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id")
    return rows.select("claim_id", Y.stable_id("claim_id").cast("string").alias("point_id"))


@registry.query(
    """SELECT doc, max(updated_at) AS updated_at, arg_max(body, (updated_at, body)) AS body FROM (
      SELECT user_id AS doc, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at, event_type AS body FROM events)
    GROUP BY 1"""
)
def document_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        F.col("event_type").alias("body"),
    )
    first_half = F.col("updated_at") < "2024-01-15"
    return Y.upsert(rows.where(first_half), rows.where(~first_half), "doc", "updated_at")


@registry.query(
    """SELECT doc, max(updated_at) AS updated_at, arg_max(body, (updated_at, body)) AS body,
      CASE WHEN max(updated_at) < '2024-01-15' THEN 1 ELSE 2 END::BIGINT AS batch FROM (
      SELECT user_id AS doc, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at, event_type AS body FROM events)
    GROUP BY 1"""
)
def bucketed_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        F.col("event_type").alias("body"),
    )
    first_half = F.col("updated_at") < "2024-01-15"
    path = scratch_path(spark)
    Y.write_bucketed(rows.where("false").withColumn("batch", F.lit(0).cast("long")), path, "doc", 16)
    for batch, part in enumerate((rows.where(first_half), rows.where(~first_half)), 1):
        Y.upsert_into(path, part, "doc", "updated_at", batch, 16)
    return spark.read.schema("doc long, updated_at string, body string, batch long, bucket int").parquet(path).drop("bucket")


@registry.query()
def indexed_similarity_search(spark, sf_dir):
    """The nearest rows of every twentieth vector, by an index."""
    vectors = table(spark, sf_dir, "embeddings")
    path = scratch_path(spark)
    Y.build_index(vectors, path, "vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return Y.search_index(path, queries, "vec_id", "embedding", threshold=0.0)
