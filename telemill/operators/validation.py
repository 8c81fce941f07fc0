"""Contract rules as one column: the first rule a signal breaks, or null."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, functions as F

from telemill import contract as C
from telemill.functions.columns import computed_once, has_key

# Error codes, in the order the rules are checked.
INVALID_SEMVER = "invalid_semver"
VERSION_MISMATCH = "version_mismatch"
EMPTY_SERVICE_NAME = "empty_service_name"
NEGATIVE_TIMESTAMP = "negative_timestamp"
INVALID_SPAN_INTERVAL = "invalid_span_interval"
INVALID_TRACE_ID = "invalid_trace_id"
INVALID_SPAN_ID = "invalid_span_id"
EMPTY_METRIC_NAME = "empty_metric_name"
MISSING_RESOURCE_KEY = "missing_resource_key"

_SEMVER = r"^[0-9]+\.[0-9]+\.[0-9]+\z"
_HEX32 = r"^[0-9a-f]{32}\z"
_HEX16 = r"^[0-9a-f]{16}\z"


def _rule(broken: Column, code: str) -> Column:
    return F.when(broken, F.lit(code))


def _head(version: str) -> list[Column]:
    return [
        _rule(~F.col("contract_version").rlike(_SEMVER), INVALID_SEMVER),
        _rule(F.col("contract_version") != version, VERSION_MISMATCH),
        _rule(F.col("service_name") == "", EMPTY_SERVICE_NAME),
    ]


def _keys(required) -> list[Column]:
    return [F.when(~has_key("resource_attributes", k), F.lit(f"{MISSING_RESOURCE_KEY}:{k}"))
            for k in required]


def validate_log(required=C.REQUIRED_RESOURCE_KEYS, version=C.CONTRACT_VERSION) -> Column:
    return F.coalesce(*_head(version), _rule(F.col("time_unix_nano") < 0, NEGATIVE_TIMESTAMP),
                      *_keys(required))


def validate_span(required=C.REQUIRED_RESOURCE_KEYS, version=C.CONTRACT_VERSION) -> Column:
    parent = F.col("parent_span_id")
    return F.coalesce(
        *_head(version),
        _rule(F.col("start_unix_nano") < 0, NEGATIVE_TIMESTAMP),
        _rule(F.col("end_unix_nano") < F.col("start_unix_nano"), INVALID_SPAN_INTERVAL),
        _rule(~F.col("trace_id").rlike(_HEX32), INVALID_TRACE_ID),
        _rule(~F.col("span_id").rlike(_HEX16), INVALID_SPAN_ID),
        _rule(parent.isNotNull() & ~parent.rlike(_HEX16), INVALID_SPAN_ID),
        *_keys(required))


def validate_metric(required=C.REQUIRED_RESOURCE_KEYS, version=C.CONTRACT_VERSION) -> Column:
    return F.coalesce(*_head(version), _rule(F.col("time_unix_nano") < 0, NEGATIVE_TIMESTAMP),
                      _rule(F.col("name") == "", EMPTY_METRIC_NAME), *_keys(required))


def validate(signals: DataFrame, required=C.REQUIRED_RESOURCE_KEYS,
             version=C.CONTRACT_VERSION) -> DataFrame:
    """Add ``error_code``.  Works on mixed signals; rows with a parse error keep null."""
    code = (
        F.when(F.col("signal_type") == "log", validate_log(required, version))
        .when(F.col("signal_type") == "span", validate_span(required, version))
        .when(F.col("signal_type") == "metric", validate_metric(required, version))
    )
    if "parse_error" in signals.columns:
        code = F.when(F.col("parse_error").isNull(), code)
    return computed_once(signals, error_code=code)


# -- policies -----------------------------------------------------------------


def _check(policy: str) -> None:
    if policy not in C.POLICIES:
        raise ValueError(f"unknown validation policy: {policy}")


def apply_policy(validated: DataFrame, policy: str) -> DataFrame:
    """``off`` and ``warn`` keep every signal, ``strict`` keeps the conformant ones."""
    _check(policy)
    kept = validated
    if "parse_error" in kept.columns:
        kept = kept.filter(F.col("parse_error").isNull())
    return kept.filter(F.col("error_code").isNull()) if policy == "strict" else kept


def rejects(validated: DataFrame, policy: str) -> DataFrame:
    """Signals the policy counts as rejected; ``off`` checks nothing and counts nothing."""
    _check(policy)
    bad = validated.filter(F.col("error_code").isNotNull())
    return bad.limit(0) if policy == "off" else bad


def policy_counts(validated: DataFrame, policies=C.POLICIES) -> DataFrame:
    """Kept and rejected signals under each policy, from one pass."""
    if "parse_error" in validated.columns:
        validated = validated.filter(F.col("parse_error").isNull())
    bad = F.count_if(F.col("error_code").isNotNull())
    total = validated.agg(F.count("*").alias("n"), bad.alias("bad"))
    rows = F.array(*[
        F.struct(F.lit(p).alias("policy"),
                 (F.col("n") - F.col("bad") if p == "strict" else F.col("n")).alias("kept"),
                 (F.lit(0).cast("bigint") if p == "off" else F.col("bad")).alias("rejected"))
        for p in policies])
    return total.select(F.inline(rows))


def _counts(columns: list[str]) -> list[Column]:
    ok = F.col("error_code").isNull()
    unread = F.lit(False)
    if "parse_error" in columns:
        ok = ok & F.col("parse_error").isNull()
        unread = F.col("parse_error").isNotNull()
    return [
        F.count_if(ok & (F.col("signal_type") == "log")).alias("logs"),
        F.count_if(ok & (F.col("signal_type") == "span")).alias("spans"),
        F.count_if(ok & (F.col("signal_type") == "metric")).alias("metrics"),
        F.count_if(unread).alias("parse_errors"),
        F.count_if(F.col("error_code").isNotNull()).alias("validation_errors"),
    ]


def signal_counts(validated: DataFrame) -> DataFrame:
    """Logs, spans, metrics that passed, and the two kinds of error, in one row."""
    return validated.agg(*_counts(validated.columns))


def batch_gate(validated: DataFrame, batch: Column) -> DataFrame:
    """The strict gate for many batches at once: the counts of each and whether it is refused as a whole."""
    return validated.groupBy(batch.alias("batch")).agg(*_counts(validated.columns)).withColumn(
        "refused", (F.col("parse_errors") > 0) | (F.col("validation_errors") > 0))


#: Rules by which a reject is counted; a missing key counts as one rule, whichever key it is.
REASONS = (INVALID_SEMVER, VERSION_MISMATCH, EMPTY_SERVICE_NAME, NEGATIVE_TIMESTAMP, INVALID_SPAN_INTERVAL,
           INVALID_TRACE_ID, INVALID_SPAN_ID, EMPTY_METRIC_NAME, MISSING_RESOURCE_KEY)
KINDS = ("log", "span", "metric")


class Tally:
    """Signal counts and the reject matrix, taken while a batch is written instead of by another scan."""

    def __init__(self):
        self._seen = Observation(f"tally-{uuid.uuid4().hex}")

    def watch(self, validated: DataFrame) -> DataFrame:
        """``validated``, observed: the figures are there once an action has written it."""
        rule = F.substring_index("error_code", ":", 1)
        cells = [F.count_if((rule == reason) & (F.col("signal_type") == kind)).alias(f"{reason}/{kind}")
                 for reason in REASONS for kind in KINDS]
        return validated.observe(self._seen, *_counts(validated.columns), *cells)

    def counts(self) -> dict[str, int]:
        return {n: v for n, v in self._seen.get.items() if "/" not in n}

    def rejects(self) -> dict[tuple[str, str], int]:
        """``{(reason, signal): rejected}`` of the rules that were broken."""
        return {tuple(n.split("/")): v for n, v in self._seen.get.items() if "/" in n and v}


class BatchRejected(ValueError):
    """A strict batch held at least one bad record; nothing of it was written."""


def strict_batch_gate(validated: DataFrame) -> dict[str, int]:
    """Counts of an error-free batch; raises when any record is bad.

    One row reaches the driver: the decision to write or not is the caller's.
    """
    counts = signal_counts(validated).first().asDict()
    if counts["parse_errors"] or counts["validation_errors"]:
        raise BatchRejected(
            f"{counts['parse_errors']} parse and {counts['validation_errors']} contract errors")
    return counts


def reject_matrix(validated: DataFrame) -> DataFrame:
    """Rejected signals by broken rule and signal kind."""
    rule = F.regexp_extract("error_code", r"^([a-z_]+)", 1)
    return (validated.filter(F.col("error_code").isNotNull())
            .groupBy(rule.alias("reason"), F.col("signal_type").alias("signal"))
            .agg(F.count("*").alias("rejected")))
