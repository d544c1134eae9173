"""Business rules as expressions and small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words for the ratings 1 to 5.
RATING_WORDS = {1: "beginner", 2: "competent", 3: "proficient", 4: "proficient", 5: "expert"}

# Ranks of education levels; what is not listed has none.
EDUCATION_RANKS = {
    "No Formal Education": 0,
    "GED": 1,
    "High School Diploma": 2,
    "Post High School": 3,
    "Certificate": 4,
    "Associate's Degree": 5,
    "Bachelor's Degree": 6,
    "Master's Degree": 7,
    "Doctorate": 8,
}

# Enrolled with a partner, completed a partner's program, technical experience, degree or technical program, career
# preparation complete; then pool and track.
POOLS = (
    (False, False, False, False, False, "Not Job Ready", None),
    (False, False, False, False, True, "Not Job Ready", None),
    (False, False, False, True, False, "Job Ready", "STANDARD"),
    (False, False, False, True, True, "Recommended", None),
    (False, False, True, False, False, "Job Ready", "STANDARD"),
    (False, False, True, False, True, "Recommended", None),
    (False, False, True, True, False, "Job Ready", "ACCELERATED"),
    (False, False, True, True, True, "Recommended", None),
    (False, True, False, False, False, "Job Ready", None),
    (False, True, False, False, True, "Job Ready", None),
    (False, True, False, True, False, "Job Ready", None),
    (False, True, False, True, True, "Recommended", None),
    (False, True, True, False, False, "Recommended", None),
    (False, True, True, False, True, "Recommended", None),
    (False, True, True, True, False, "Recommended", None),
    (False, True, True, True, True, "Recommended", None),
    (True, False, False, False, False, "Not Job Ready", None),
    (True, False, False, False, True, "Not Job Ready", None),
    (True, False, False, True, False, "Job Ready", None),
    (True, False, False, True, True, "Recommended", None),
    (True, False, True, False, False, "Recommended", None),
    (True, False, True, False, True, "Recommended", None),
    (True, False, True, True, False, "Recommended", None),
    (True, False, True, True, True, "Recommended", None),
    (True, True, False, False, False, "Job Ready", None),
    (True, True, False, False, True, "Recommended", None),
    (True, True, False, True, False, "Recommended", None),
    (True, True, False, True, True, "Recommended", None),
    (True, True, True, False, False, "Recommended", None),
    (True, True, True, False, True, "Recommended", None),
    (True, True, True, True, False, "Recommended", None),
    (True, True, True, True, True, "Recommended", None),
)
POOL_FLAGS = ("enrolled", "completed", "experienced", "educated", "prepared")


def label(value: Column, labels: dict, default: str | None = None) -> Column:
    """The label of a value; the default for others and for null."""
    cases = reduce(lambda w, kv: w.when(value == kv[0], kv[1]), labels.items(), F.when(F.lit(False), None))
    return cases.otherwise(F.lit(default)) if default is not None else cases


def rating_word(score: Column) -> Column:
    return label(score, RATING_WORDS, "N/A")


def average(*scores: Column) -> Column:
    """Mean of rating items to two places; null if any item is."""
    total = reduce(lambda a, b: a + b, [s.cast("int") for s in scores])
    return F.round(total / F.lit(float(len(scores))), 2).cast("decimal(3,2)")


def education_at_least(level: Column, least: str) -> Column:
    """Whether a level ranks at or above another; false for unknown levels."""
    return F.coalesce(label(level, EDUCATION_RANKS) >= EDUCATION_RANKS[least], F.lit(False))


def pools(spark: SparkSession) -> DataFrame:
    """The decision table: five answers, pool, track."""
    return spark.createDataFrame(list(POOLS), ", ".join(f"{f} boolean" for f in POOL_FLAGS) + ", pool string, track string")


def assign_pools(people: DataFrame) -> DataFrame:
    """People, with a column for each of POOL_FLAGS, with pool and track; 'None' and null where an answer is missing."""
    found = people.join(F.broadcast(pools(people.sparkSession)), list(POOL_FLAGS), "left")  # 32 rows
    return found.withColumn("pool", F.coalesce("pool", F.lit("None")))


def spam_band(score: Column) -> Column:
    """Below 0.7 a posting proceeds, up to 0.9 it is flagged, above it is rejected; a null score proceeds nowhere."""
    return F.when(score < 0.7, "proceed").when(score <= 0.9, "flag").when(score > 0.9, "reject")


def quality(title: Column, body: Column, keywords: tuple[str, ...]) -> Column:
    """Quality of a posting between 0 and 1: completeness, clarity, density of keywords and coherence, a quarter each (weights are ours)."""
    words = F.size(F.split(F.trim(F.coalesce(body, F.lit(""))), r"\s+"))
    complete = (F.length(F.coalesce(title, F.lit(""))) > 0).cast("double") / 2 + F.least(words / 100.0, F.lit(1.0)) / 2
    sentences = F.greatest(F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"[.!?]")), F.lit(1))
    clear = F.when((words / sentences).between(3, 40), 1.0).otherwise(0.5)
    held = reduce(lambda a, b: a + b, [F.lower(F.coalesce(body, F.lit(""))).contains(k).cast("int") for k in keywords])
    dense = F.least(held / float(max(1, len(keywords))), F.lit(1.0))
    shared = F.size(F.array_intersect(F.split(F.lower(F.coalesce(title, F.lit(""))), r"\s+"), F.split(F.lower(F.coalesce(body, F.lit(""))), r"\s+")))
    coherent = F.when(F.length(F.coalesce(title, F.lit(""))) == 0, 0.0).otherwise(shared / F.greatest(F.size(F.array_distinct(F.split(F.lower(title), r"\s+"))), F.lit(1)))
    return (complete + clear + dense + coherent) / 4


def truthy(a: Column) -> Column:
    return F.coalesce(F.lower(F.trim(a)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to two places; 0 for an empty whole."""
    return F.when(whole == 0, 0).otherwise(F.round(100.0 * part / whole, 2)).cast("decimal(5,2)")


# Words of a title by role; the first that fits counts.
ROLES = (("data", "data|analy|machine learning"), ("security", "security|cyber"), ("support", "support|help ?desk"), ("design", "design|ux"), ("engineering", "engineer|develop|program"))


def role(title: Column) -> Column:
    """The role of a title; 'other' if no rule fits."""
    low = F.lower(title)
    return reduce(lambda w, r: w.when(low.rlike(r[1]), r[0]), ROLES, F.when(F.lit(False), None)).otherwise("other")


def seniority(title: Column) -> Column:
    low = F.lower(title)
    return (
        F.when(low.rlike(r"\b(?:lead|principal|head|chief)\b"), "lead")
        .when(low.rlike(r"\b(?:senior|sr)\b"), "senior")
        .when(low.rlike(r"\b(?:junior|jr|intern|entry)\b"), "junior")
        .otherwise("mid")
    )


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance of two points given in degrees."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lng2 - lng1) / 2) ** 2
    return 2 * 3958.7613 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
