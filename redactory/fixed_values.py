"""Domains, constants and tables whose exact content decides results.

Everything here is data.  Nothing in this module computes anything.
"""

# --- fixed values: entity catalogue ---------------------------------------
ENTITIES = [
    "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "US_SSN",
    "US_PASSPORT", "US_DRIVER_LICENSE", "US_ITIN", "US_BANK_NUMBER",
    "IP_ADDRESS", "URL", "IBAN_CODE", "DATE_TIME",
    "LOCATION", "PERSON", "NRP", "MEDICAL_LICENSE", "ORGANIZATION",
]
DENY_ENTITY = "CUSTOM_DENYLIST"
DEFAULT_THRESHOLD = 0.35
MASK_CHARS = 20

# --- fixed values: rewrite operators --------------------------------------
OPERATORS = ["replace", "redact", "mask", "hash", "synthesize"]

# --- fixed values: record domains -----------------------------------------
CARD_STATUSES = ["backlog", "in_progress", "review", "done"]
PRIORITIES = ["low", "medium", "high", "critical"]
SEVERITIES = ["info", "warning", "critical"]
APPOINTMENT_STATUSES = ["scheduled", "completed", "cancelled"]

# --- fixed values: confidence bands, lower bound in percent ----------------
CONFIDENCE_BANDS = [("Very High", 90), ("High", 75), ("Medium", 60), ("Low", 0)]

# --- fixed values: job duration buckets in seconds, +Inf is implicit -------
DURATION_BUCKETS = [5, 15, 30, 60, 120, 300, 600]

# --- fixed values: terminal job statuses ----------------------------------
TERMINAL_JOB_STATUSES = ["COMPLETED", "FAILED", "CANCELED", "SKIPPED", "ABANDONED"]

# --- fixed values: scheduler status -> job status --------------------------
JOB_STATUS_NAMES = {
    "SUBMITTED": "submitted", "BLOCKED": "blocked", "PENDING": "pending",
    "RUNNING": "running", "CANCELED": "cancelled", "FAILED": "failed",
    "COMPLETED": "done", "SKIPPED": "skipped", "ABANDONED": "abandoned",
}

# --- fixed values: status label rules; the first rule with a hit wins ------
STATUS_LABEL_RULES = [
    (["reject"], "Rejected"),
    (["fail", "error"], "Failed"),
    (["cancel"], "Cancelled"),
    (["abandon"], "Abandoned"),
    (["skip"], "Skipped"),
    (["complete", "done", "success"], "Completed"),
    (["run"], "Running"),
    (["block"], "Blocked"),
    (["pend"], "Pending"),
    (["submit"], "Submitted"),
]
STATUS_LABEL_DEFAULT = "Submitted"
STATUS_LABEL_BLANK = "—"

# --- fixed values: words in a progress message that mean failure -----------
ERROR_WORDS = ["rejected", "failed", "error"]

# --- fixed values: quick screen for personal data --------------------------
# e-mail, social security number, phone, card; word edges are spelled out as
# classes so that every regex dialect reads them alike.
QUICK_SCREEN_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
QUICK_SCREEN_DIGITS = (
    r"(?:^|[^\p{L}\p{N}_])(?:"
    r"[0-9]{3}[-. \t\r\n][0-9]{2}[-. \t\r\n][0-9]{4}"
    r"|[0-9]{3}[-. \t\r\n][0-9]{3}[-. \t\r\n][0-9]{4}"
    r"|(?:[0-9][ -]?){12,15}[0-9]"
    r")(?:$|[^\p{L}\p{N}_])"
)
TEXT_COLUMN_SAMPLE = 100
TEXT_COLUMN_MIN_WORDS = 1.5
TEXT_COLUMN_FALLBACK = 8

# --- fixed values: place table (city, latitude, longitude) in match order ---
CITIES = [
    ("new york", 40.7128, -74.0060),
    ("los angeles", 34.0522, -118.2437),
    ("chicago", 41.8781, -87.6298),
    ("atlanta", 33.7490, -84.3880),
    ("austin", 30.2672, -97.7431),
    ("dallas", 32.7767, -96.7970),
    ("denver", 39.7392, -104.9903),
    ("seattle", 47.6062, -122.3321),
    ("miami", 25.7617, -80.1918),
    ("san francisco", 37.7749, -122.4194),
    ("washington", 38.9072, -77.0369),
    ("boston", 42.3601, -71.0589),
    ("houston", 29.7604, -95.3698),
    ("phoenix", 33.4484, -112.0740),
    ("philadelphia", 39.9526, -75.1652),
    ("london", 51.5072, -0.1276),
    ("paris", 48.8566, 2.3522),
    ("berlin", 52.5200, 13.4050),
    ("tokyo", 35.6762, 139.6503),
    ("sydney", -33.8688, 151.2093),
    ("toronto", 43.6532, -79.3832),
    ("vancouver", 49.2827, -123.1207),
]
CITY_ALIASES = [
    ("new york city", "new york"),
    ("nyc", "new york"),
    ("la", "los angeles"),
    ("sf", "san francisco"),
    ("bay area", "san francisco"),
    ("washington dc", "washington"),
    ("washington d c", "washington"),
]
LOCATION_ENTITIES = ["LOCATION", "GPE", "LOC"]

# --- fixed values: recogniser labels folded onto the catalogue -------------
LABEL_FOLD = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION", "GPE": "LOCATION"}

# --- fixed values: file admission -----------------------------------------
MAX_FILE_BYTES = 500 * 1024 * 1024
ZIP_HEADER = "504B0304"
OLE_HEADER = "D0CF11E0"

# --- fixed values: attestation payload ------------------------------------
# The schema tag is an argument of the digest; this is the library's own.
ATTESTATION_SCHEMA = "redactory.attestation.v1"

# --- fixed values: audit retention ----------------------------------------
AUDIT_RETENTION_ROWS = 100_000
