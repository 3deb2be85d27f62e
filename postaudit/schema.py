"""Row types and the fixed values the audit must reproduce exactly."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: phrase lists, scores, reasons, messages -----------------------------

CASCADE_THREAT = [
    "kill yourself", "kys", "go die", "should die", "i'll kill you", "going to kill", "threaten to",
]
CASCADE_HATE = ["deserves to die", "should be killed"]

RULE_ABUSIVE = [
    "stupid", "idiot", "moron", "retard", "dumbass", "asshole", "fuck you", "fuck off",
    "go to hell", "kill yourself", "kys", "you're a", "you are a",
]
RULE_HATE = [
    "i hate", "i despise", "i loathe", "all [group] are", "every [group] is",
    "should die", "deserves to die", "should be killed",
]
RULE_THREAT = [
    "i'll kill", "i will kill", "going to kill", "i'll hurt", "i will hurt", "going to hurt",
    "threaten", "threatening",
]

REASON_BLOCKED = "Contains blocked phrase: "
REASON_CASCADE_THREAT = "Contains threatening language"
REASON_CASCADE_HATE = "Contains hate speech patterns"
REASON_RULE_ABUSIVE = "Contains abusive or offensive language"
REASON_RULE_HATE = "Contains hate speech or violent language"
REASON_RULE_THREAT = "Contains threats or violent language"
REASON_CLEAN = "No issues detected"

SCORER_REASON = "llm_scorer"

# Characters with the Unicode White_Space property.
WHITE_SPACE = "".join(map(chr, [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))

POST_URL_BASE = "https://twitter.com/i/web/status/"
ZIP_MAGIC_HEX = "504B0304"
PAGE_SIZE_DEFAULT = 20
PAGE_SIZE_MAX = 100
DAILY_QUOTA = 10_000_000
MAX_RETRIES = 3
QUOTA_MARKERS = ["RESOURCE_EXHAUSTED", "quota exceeded", "Quota exceeded", "daily quota", "Daily quota"]

ERROR_NO_MEMBER = "no tweet.js or tweets.js file found in ZIP archive"
ERROR_ZIP = "failed to open ZIP archive"
ERROR_UNWRAP = "could not extract JSON from JS wrapper - file may not be a valid tweet.js file"
ERROR_JSON = "failed to parse JSON"
ERROR_OPEN = "failed to open file"
ERROR_PREFIX = "failed to parse archive: "

# Counters of a job that add up over runs and batches.
COUNTS = ("posts", "filtered", "flagged", "scored", "calls")
COUNTS_DDL = "job_id STRING, " + ", ".join(f"{c} BIGINT" for c in COUNTS)

# --- row types -------------------------------------------------------------------------

RAW_POST_DDL = (
    "tweet STRUCT<id_str: STRING, full_text: STRING, text: STRING, created_at: STRING, "
    "entities: STRUCT<urls: ARRAY<STRUCT<expanded_url: STRING, url: STRING>>, "
    "hashtags: ARRAY<STRUCT<text: STRING>>, "
    "user_mentions: ARRAY<STRUCT<screen_name: STRING>>, "
    "media: ARRAY<STRUCT<media_url: STRING>>>>"
)

CRITERIA_DDL = (
    "forbidden_words ARRAY<STRING>, professional_check BOOLEAN, tone STRING, exclude_politics BOOLEAN, "
    "exclude_profanity BOOLEAN, exclude_threats BOOLEAN, exclude_hate_speech BOOLEAN, "
    "exclude_harassment BOOLEAN"
)

RESULT_DDL = "should_flag BOOLEAN, score DOUBLE, reason STRING, labels ARRAY<STRING>"

SCORED_DDL = (
    f"job_id STRING, tweet_id STRING, text STRING, created_at TIMESTAMP, result STRUCT<{RESULT_DDL}>, "
    "score_status STRING, score_error STRING, scored_at TIMESTAMP"
)

FLAGGED_DDL = (
    "id STRING, tweet_id STRING, job_id STRING, text STRING, created_at TIMESTAMP, flagged_at TIMESTAMP, "
    "reason STRING, score DOUBLE, url STRING, filter_reason STRING"
)

ARCHIVE_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
