"""Column functions of the block model: checksums, formats, names, errors, freshness and delays. All stay in the JVM."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

GIB = 1 << 30
#: Error codes by class.
THROTTLE_CODES = ("Throttling", "ThrottlingException", "RequestThrottled", "RequestThrottledException", "RequestLimitExceeded", "TooManyRequestsException")
SERVER_CODES = ("ServiceUnavailable", "InternalError", "InternalFailure", "InternalServerError", "InternalServerException", "ServiceUnavailableException", "SlowDown")
DENIED_CODES = ("AccessDeniedException", "AccessDenied", "UnauthorizedOperation", "UnrecognizedClientException")
TRANSIENT_ERRNOS = ("ECONNRESET", "ECONNABORTED", "ECONNREFUSED", "ETIMEDOUT", "EPIPE")
#: Codes of our own for errors without a code of the service.
CHECKSUM, NETWORK = "ChecksumMismatch", "NetworkError"
RETRYABLE = (*THROTTLE_CODES, *SERVER_CODES, *TRANSIENT_ERRNOS, CHECKSUM, NETWORK)


def block_checksum(data: Column) -> Column:
    """base64 of SHA-256."""
    return F.base64(F.unhex(F.sha2(data, 256)))


def hex_digest(data: Column) -> Column:
    return F.sha2(data, 256)


def is_zero(data: Column) -> Column:
    """All bytes are zero; an empty value counts. For payloads of block size prefer operators.payload.zero_flags."""
    return F.translate(F.hex(data), "0", "") == ""


def is_zero_text(data: Column) -> Column:
    return F.translate(data, "0", "") == ""


def usd(amount: Column) -> Column:
    """$0; four places below a cent, three below a dollar, else two."""
    amount = amount.cast("double")
    return (
        F.when(amount == 0, F.lit("$0"))
        .when(amount < 0.01, F.format_string("$%.4f", amount))
        .when(amount < 1, F.format_string("$%.3f", amount))
        .otherwise(F.format_string("$%.2f", amount))
    )


def human_count(n: Column) -> Column:
    return F.format_number(n, 0)


def human_bytes(n: Column) -> Column:
    n = n.cast("long")
    part = lambda size, form: F.format_string(form, n / F.lit(float(size)))
    return (
        F.when(n >= GIB, part(GIB, "%.2f GiB"))
        .when(n >= 1 << 20, part(1 << 20, "%.1f MiB"))
        .when(n >= 1 << 10, part(1 << 10, "%.1f KiB"))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def safe_name(name: Column) -> Column:
    """Slashes to dashes, and all but letters, digits, _ and - to dashes."""
    return F.regexp_replace(F.replace(name, F.lit("/"), F.lit("-")), "[^A-Za-z0-9_-]", "-")


def device_name(device: Column, ordinal: Column) -> Column:
    """A device's file name: without a leading /dev/; `volume<n>` if nothing is left."""
    plain = safe_name(F.regexp_replace(F.coalesce(device, F.lit("")), "^/dev/", ""))
    return F.when(plain == "", F.concat(F.lit("volume"), ordinal.cast("string"))).otherwise(plain)


def manifest_path(artifact: Column) -> Column:
    """The manifest beside an image or its archive (.img, .img.zst); any other name gets the suffix."""
    return F.concat(F.regexp_replace(artifact, r"\.img(\.zst)?$", ""), F.lit(".manifest.json"))


def egress_note(gb: Column, rate: Column, cost: Column) -> Column:
    """The part of an estimate that is transfer, empty where there is none."""
    return F.when(cost == 0, F.lit("")).otherwise(F.format_string("; egress %.1f GB @ %s/GB = %s", gb.cast("double"), usd(rate), usd(cost)))


def error_class(code: Column) -> Column:
    return (
        F.when(code.isin(*THROTTLE_CODES), "throttle")
        .when(code.isin(*SERVER_CODES), "server")
        .when(code.isin(*DENIED_CODES), "denied")
        .otherwise("other")
    )


def is_retryable(code: Column, message: Column) -> Column:
    """Checksum mismatches, throttling, server and connection errors; without a code, ends of input where there should be
    none."""
    return F.when(code.isNotNull(), code.isin(*RETRYABLE)).otherwise(F.coalesce(message.contains("unexpected EOF"), F.lit(False)))


def token_fresh(expiry: Column, now: Column, margin: str = "2 minutes") -> Column:
    """Without an expiry a token is fresh."""
    return expiry.isNull() | (now <= expiry - F.expr(f"INTERVAL {margin}"))


def backoff(attempt: Column, base: float = 0.5, most: float = 30.0) -> tuple[Column, Column]:
    """The least and the upper bound of the delay in seconds before a further attempt."""
    high = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return high / 2, high
