"""Code lists, weights, limits and phrases the results depend on."""

# --- scored billing rules: fixed values -------------------------------------
# name -> (fraud type, weight, threshold)
RULES = {
    "upcoding_complexity": ("upcoding", 0.80, 0.70),
    "phantom_billing_schedule": ("phantom_billing", 0.90, 0.80),
    "phantom_billing_location": ("phantom_billing", 0.95, 0.90),
    "unbundling_detection": ("unbundling", 0.85, 0.75),
    "staged_accident_pattern": ("staged_accident", 0.90, 0.80),
    "prescription_fraud_volume": ("prescription_fraud", 0.80, 0.70),
    "kickback_referral_pattern": ("kickback_scheme", 0.75, 0.70),
    "billing_frequency_anomaly": ("general", 0.60, 0.60),
    "amount_anomaly": ("general", 0.70, 0.65),
}

THRESHOLDS = {
    "max_daily_claims_per_provider": 50,
    "max_amount_per_claim": 10000,
    "suspicious_amount_multiplier": 3.0,
    "max_procedures_per_claim": 10,
    "max_patient_visits_per_day": 3,
    "phantom_billing_hours": {"start": 6, "end": 22},
    "prescription_daily_limit": 5,
    "referral_concentration_threshold": 0.7,
}

HIGH_COMPLEXITY_PROCEDURES = ["99215", "99285", "99291", "99292"]
SIMPLE_DIAGNOSES = ["Z00.00", "Z12.11", "I10", "E11.9"]
AVERAGE_PROCEDURE_COST = 150
BUNDLES = {
    "colonoscopy": ["45378", "45380", "45384", "45385"],
    "cataract_surgery": ["66984", "66982", "66983"],
    "knee_arthroscopy": ["29881", "29882", "29883"],
    "cardiac_cath": ["93454", "93455", "93456", "93457"],
}
AUTO_INJURY_CODES = ["S72.001A", "S06.0X0A", "M99.23", "M54.2"]
STAGED_PATTERNS = [["S72.001A", "S06.0X0A"], ["M99.23", "M54.2"]]
PRESCRIPTION_CODES = ["J1100", "J2001", "J3420", "J7799"]
CONTROLLED_CODES = ["J2315", "J1170", "J2405"]
ADEQUATE_DIAGNOSES = ["M79.3", "G89.29", "F32.9"]
FEE_SCHEDULE = {
    "99213": 125,
    "99214": 185,
    "99215": 250,
    "99285": 350,
    "71046": 85,
    "93000": 45,
}
DEFAULT_FEE = 100
RULE_HOLIDAYS = ["01-01", "07-04", "12-25"]
PROVIDER_HISTORY = 100
PATIENT_HISTORY = 50
SHOPPING_LOOKBACK = 30
SHOPPING_PROVIDERS = 5

# --- validation: fixed values ------------------------------------------------
CLAIM_ID_PATTERN = r"^CLM-\d{4}-[A-Z0-9]+$"
PATIENT_ID_PATTERN = r"^PAT-[A-Z0-9-]+$"
PROVIDER_ID_PATTERN = r"^PRV-[A-Z0-9-]+$"
NPI_PATTERN = r"^\d{10}$"
MAX_DAILY_AMOUNT = 50000
MAX_PROCEDURE_CODES = 20
MAX_PROVIDER_DAY = 50
FLAG_PHRASES = {
    "phantom_billing_indicators": [
        "Service on Sunday when office closed",
        "Sequential SSN pattern",
        "No corresponding appointment records",
        "Patient address doesn't exist",
    ],
    "upcoding_indicators": [
        "Procedure complexity mismatch",
        "Inconsistent diagnosis severity",
        "Billing pattern anomaly",
    ],
    "unbundling_indicators": [
        "Related procedures billed separately",
        "Unusual procedure combinations",
        "Multiple claims same day",
    ],
}
ER_CODES = ["99281", "99282", "99283", "99284", "99285"]
ROUTINE_PREFIXES = ["Z00", "Z01"]

# --- features: fixed values --------------------------------------------------
COMPLEXITY = {
    "99211": 1, "99212": 2, "99213": 3, "99214": 4, "99215": 5,
    "99281": 1, "99282": 2, "99283": 3, "99284": 4, "99285": 5,
}
DEFAULT_COMPLEXITY = 3
SEVERITY = {"E11": 2, "I10": 1, "J18": 3, "S72": 4, "F32": 2}
DEFAULT_SEVERITY = 2
FEATURE_HOLIDAYS = [
    "01-01", "07-04", "12-25", "01-15", "02-19",
    "05-27", "09-03", "10-08", "11-11", "11-22",
]
REFERRAL_CODES = ["99241", "99242", "99243", "99244", "99245"]
KEYWORDS = ["urgent", "emergency", "critical", "severe", "complications"]
EPOCH = "2020-01-01"

# --- missing data: fixed values ----------------------------------------------
CRITICALITY = {
    "diagnosis_codes": 0.95,
    "procedure_codes": 0.95,
    "billed_amount": 0.90,
    "date_of_service": 0.90,
    "provider_npi": 1.00,
    "patient_id": 1.00,
    "claim_id": 1.00,
    "diagnosis_descriptions": 0.80,
    "procedure_descriptions": 0.80,
    "provider_specialty": 0.75,
    "service_location": 0.75,
    "claim_type": 0.85,
    "treatment_type": 0.60,
    "days_supply": 0.55,
    "medical_necessity": 0.65,
    "provider_id": 0.60,
    "service_location_desc": 0.25,
    "rendering_hours": 0.40,
    "notes": 0.15,
    "red_flags": 0.20,
    "day_of_week": 0.10,
}
REQUIRED_FIELDS = [
    "claim_id", "patient_id", "provider_npi",
    "date_of_service", "billed_amount", "claim_type",
]
CONDITIONAL_FIELDS = {
    "professional": ["diagnosis_codes", "procedure_codes"],
    "pharmacy": ["ndc_code", "drug_name", "days_supply"],
    "no_fault": ["accident_date", "medical_treatment_type"],
}
UNKNOWN_CRITICALITY = 0.50
IMPORTANT = 0.50

# --- combined scoring: fixed values ------------------------------------------
RULE_WEIGHT, ML_WEIGHT, ANOMALY_WEIGHT = 0.3, 0.5, 0.2
FRAUD_THRESHOLD, HIGH_RISK, MEDIUM_RISK = 0.7, 0.9, 0.5
TARGET_ACCURACY, TARGET_FPR = 0.94, 0.038

# --- confidence and signals: fixed values --------------------------------------
FACTOR_WEIGHTS = {
    "retrieval_quality": 0.40,
    "source_diversity": 0.20,
    "temporal_relevance": 0.15,
    "cross_validation": 0.15,
    "regulatory_citation": 0.10,
}
KNOWLEDGE_SOURCES = ["patient", "provider", "medical_coding", "regulatory"]
HALF_LIFE_DAYS = 120.0
VIOLATION_STRENGTH = {"low": 0.40, "medium": 0.60, "high": 0.80, "critical": 0.95}

# --- design-document checks: fixed values --------------------------------------
ICD10_PATTERN = r"^[A-Z]\d{2}(\.\d{1,4})?$"
CPT_PATTERN = r"^(\d{5}|\d{4}[A-Z])$"
NDC_PATTERN = r"^\d{5}-\d{3,4}-\d{2}$"
NPI_PREFIX = "80840"
OVERRIDE_MODIFIERS = ["59", "XE", "XS", "XP", "XU"]
RRF_K = 60

# --- claims read from the star-schema tables: fixed code pools ----------------------
PROCEDURE_POOL = (
    "99211 99212 99213 99214 99215 99281 99282 99283 99284 99285 99241 99242 "
    "45378 45380 45384 45385 66984 66982 29881 29882 93454 93455 J1100 J2001 J3420 J7799 J2315 "
    "J1170 J2405 71046 93000 36415 97110 97140 80053 70450 73721 83036 99291 99292"
).split()
DIAGNOSIS_POOL = (
    "Z00.00 I10 E11.9 Z12.11 J18.9 M54.5 S72.001A S06.0X0A M99.23 M54.2 M79.3 G89.29 "
    "F32.9 J00 N39.0 S13.4XXA"
).split()
CLAIM_TYPES = {
    "AUTOMOBILE": "auto",
    "MACHINERY": "pharmacy",
    "HOUSEHOLD": "no_fault",
    "FURNITURE": "institutional",
}
ORDER_FLAGS = {
    11: "Patient address doesn't exist",
    13: "No corresponding appointment records",
    17: "Prior relationship, staged",
    19: "Kickback for referral",
}
