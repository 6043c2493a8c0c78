"""Decisions and admission: typed rejections, BLOCK / HOLD / WARN / PASS, registration policy, idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted suffixes and the upload limits.
SUFFIXES = [".mp3", ".wav", ".webm", ".flac", ".m4a", ".aac", ".ogg", ".wma"]
MAX_BYTES, MIN_SECONDS, MAX_SECONDS = 250 * 1024 * 1024, 10.0, 1800.0


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def reject_code(path: Column, n_bytes: Column, seconds: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """FLT-01/02: the first rule an upload breaks, or null."""
    return (F.when(~suffix(path).isin(suffixes), "UNSUPPORTED_TYPE").when(n_bytes <= 0, "EMPTY").when(n_bytes > MAX_BYTES, "TOO_LARGE")
            .when(seconds < MIN_SECONDS, "TOO_SHORT").when(seconds > MAX_SECONDS, "TOO_LONG"))


def decide(duplicate: Column, query_score: Column, pair_score: Column, warn: float, hold: float) -> Column:
    """FLT-08: duplicates block; hold is tested on the pair score before warn on the query score; both inclusive."""
    return F.when(duplicate, "BLOCK").when(pair_score >= hold, "HOLD").when(query_score >= warn, "WARN").otherwise("PASS")


def registration(decision: Column) -> Column:
    """FLT-09: struct of three flags: whether a signature is issued, whether registering and minting is allowed (both unless
    blocked), and whether it is registered on hold."""
    free = decision != "BLOCK"
    return F.struct(free.alias("issue_signature"), free.alias("allow_register"), (decision == "HOLD").alias("is_hold"))


def admit(requests: DataFrame, known: DataFrame, key: str = "request_key", payload: str = "payload") -> DataFrame:
    """JN-13: NEW, EXISTING (same key, same payload) or REQUEST_ID_CONFLICT (same key, other payload)."""
    k = known.select(key, F.col(payload).alias("_known"), F.lit(True).alias("_hit"))
    out = requests.join(k, key, "left")
    state = F.when(F.col("_hit").isNull(), "NEW").when(F.col(payload).eqNullSafe(F.col("_known")), "EXISTING").otherwise("REQUEST_ID_CONFLICT")
    return out.withColumn("admission", state).drop("_known", "_hit")
