"""The transfer record: columns, types, fixed parameters, and helpers that treat nulls as the engine defines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns kept from an export, in its order.
COLUMNS = [
    "TRANSFER_ID", "SENDER_USER_ID", "RECEIVER_USER_ID", "OTHER_MSISDN", "SENDER_WALLET_NUMBER", "RECEIVER_WALLET_NUMBER",
    "TRANSACTION_AMOUNT", "SENDER_PRE_BAL", "SENDER_POST_BAL", "RECEIVER_PRE_BAL", "RECEIVER_POST_BAL", "COMMISSIONS_PAID",
    "COMMISSIONS_RECEIVED", "COMMISSIONS_OTHERS", "SERVICE_CHARGE_RECEIVED", "SERVICE_CHARGE_PAID", "TRANSFER_STATUS",
    "SERVICE_TYPE", "TRANSFER_SUBTYPE", "TRANSACTION_TAG", "ACTION_TYPE", "IS_FINANCIAL", "TRANSFER_DONE", "ERROR_CODE",
    "ERROR_DESC", "ATTEMPT_STATUS", "CREATED_ON", "MODIFIED_ON", "TRANSFER_DATETIME", "SENDER_CITY", "RECEIVER_CITY",
    "GATEWAY_TYPE", "REQUEST_SOURCE", "TXNMODE", "SENDER_USER_TYPE", "RECEIVER_USER_TYPE", "SENDER_CATEGORY_CODE",
    "RECEIVER_CATEGORY_CODE", "SENDER_DOMAIN_CODE", "RECEIVER_DOMAIN_CODE", "RECONCILIATION_BY", "RECONCILIATION_FOR",
    "ORIGINAL_REF_NUMBER", "EXT_TXN_NUMBER", "REFERENCE_NUMBER",
]
NUMERIC = [
    "TRANSACTION_AMOUNT", "SENDER_PRE_BAL", "SENDER_POST_BAL", "RECEIVER_PRE_BAL", "RECEIVER_POST_BAL", "COMMISSIONS_PAID",
    "COMMISSIONS_RECEIVED", "COMMISSIONS_OTHERS", "SERVICE_CHARGE_RECEIVED", "SERVICE_CHARGE_PAID", "ERROR_CODE",
]
DATES = ["CREATED_ON", "MODIFIED_ON", "TRANSFER_DATETIME"]
REQUIRED = ["TRANSFER_ID", "CREATED_ON", "TRANSACTION_AMOUNT", "SENDER_USER_ID", "RECEIVER_USER_ID", "TRANSFER_STATUS", "SERVICE_TYPE"]
# Services whose sender has no balance, and risk thresholds.
WITHOUT_BALANCE = ["RC", "CASHIN", "B2BCASHOUT", "ENT2REG"]
MODERATE, HIGH, CRITICAL = 70, 85, 95
UNKNOWN = "__UNKNOWN__"
DATE_FORMAT = "dd/MM/yyyy HH:mm:ss"

# The columns that each engine reads besides those that all read.
_COMMON = ["TRANSFER_ID", "CREATED_ON", "SENDER_USER_ID", "RECEIVER_USER_ID", "TRANSACTION_AMOUNT", "SERVICE_TYPE", "TRANSFER_STATUS"]
_OWN = {
    "M1": ["SENDER_PRE_BAL", "SENDER_POST_BAL", "RECEIVER_PRE_BAL", "RECEIVER_POST_BAL", "TRANSFER_SUBTYPE", "ERROR_CODE", "SENDER_CITY", "GATEWAY_TYPE", "TRANSACTION_TAG", "ATTEMPT_STATUS", "SENDER_USER_TYPE", "RECEIVER_USER_TYPE"],
    "M2": ["OTHER_MSISDN", "SENDER_CITY", "RECEIVER_CITY", "TRANSACTION_TAG", "SENDER_USER_TYPE", "RECEIVER_USER_TYPE"],
    "M4": ["COMMISSIONS_PAID", "COMMISSIONS_RECEIVED", "COMMISSIONS_OTHERS", "SERVICE_CHARGE_RECEIVED", "SERVICE_CHARGE_PAID", "TRANSFER_SUBTYPE"],
    "M5": ["ERROR_CODE", "SENDER_PRE_BAL", "TRANSFER_SUBTYPE", "ATTEMPT_STATUS", "GATEWAY_TYPE", "SENDER_USER_TYPE", "RECEIVER_USER_TYPE"],
    "M6": ["RECONCILIATION_BY", "RECONCILIATION_FOR", "ORIGINAL_REF_NUMBER", "EXT_TXN_NUMBER", "REFERENCE_NUMBER", "ACTION_TYPE", "TRANSACTION_TAG"],
}


def columns_of(engine: str) -> list[str]:
    """What an engine reads; an unknown name reads the common columns."""
    return list(dict.fromkeys([*_COMMON, *_OWN.get(engine.upper()[:2], [])]))


def struct() -> T.StructType:
    """Schema of a normalised record."""
    kind = {c: T.DoubleType() for c in NUMERIC} | {c: T.TimestampNTZType() for c in DATES}
    return T.StructType([T.StructField(c, kind.get(c, T.StringType())) for c in COLUMNS])


class EngineError(Exception):
    """Any failure that the engine names."""


class InvalidData(EngineError):
    """Input that validation refuses."""


class MissingArtefact(EngineError):
    """A frozen parameter or model that is not there."""


class LeakError(EngineError):
    """A feature that knows the outcome."""


class ScoringError(EngineError):
    """A failure within one engine."""


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """x within bounds; null stays null (greatest and least skip nulls)."""
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def flag(condition: Column) -> Column:
    """1 where the condition is true, else 0, unknown included."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def number(x: Column) -> Column:
    """A tolerant cast to double; NaN becomes null."""
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))
