"""Retry rules for model calls, as Columns and as a loop."""

from __future__ import annotations

import random as _random
import re
import time
from collections.abc import Callable
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses, network codes and error names that say "try again later", the limits of waiting in ms, and the
# pattern of a delay that a message asks for.
TRANSIENT_STATUSES = [429, 500, 502, 503, 504]
TRANSIENT_CODES = [
    "ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "EPIPE", "EAI_AGAIN", "ENETUNREACH", "UND_ERR_SOCKET",
    "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT",
]
TRANSIENT_NAMES = ["AbortError", "TimeoutError"]
ATTEMPTS, BASE_MS, MAX_MS, MAX_SERVER_MS = 5, 2000, 30_000, 120_000
MAX_CAUSES = 5
RETRY_DELAY = r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"'


def is_transient(status: Column, codes: Column, names: Column | None = None) -> Column:
    """A status decides if there is one; else any code or name along the first causes."""
    first = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")), F.lit(1), F.lit(MAX_CAUSES))
    network = F.exists(first(codes), lambda x: x.isin(*TRANSIENT_CODES))
    if names is not None:
        network = network | F.exists(first(names), lambda x: x.isin(*TRANSIENT_NAMES))
    return F.when(status.isNotNull(), status.isin(*TRANSIENT_STATUSES)).otherwise(F.coalesce(network, F.lit(False)))


def is_timeout(name: Column, message: Column) -> Column:
    return F.coalesce(name == "AbortError", F.lit(False)) | F.coalesce(F.lower(message).contains("timeout"), F.lit(False))


def backoff_ms(attempt: Column, base: int = BASE_MS, most: int = MAX_MS) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1))


def delay_ms(attempt: Column, server: Column, random: Column) -> Column:
    """What the server asks for, or half the backoff and up to as much again; null if the server asks for too long."""
    b = backoff_ms(attempt)
    return F.when(server > MAX_SERVER_MS, F.lit(None)).otherwise(F.coalesce(server, F.floor(b / 2 + random * b / 2 + 0.5)))


def retry_after_ms(header: Column, message: Column, now: Column | None = None) -> Column:
    """A header of seconds or of an HTTP date; without a header, the retryDelay in a message. A bad header hides the message."""
    seconds = F.when(F.trim(header) != "", F.trim(header).try_cast("double"))
    seconds = F.when(F.isnan(seconds) | F.abs(seconds).isin(float("inf")), F.lit(None)).otherwise(seconds)
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    # the zone is part of what is parsed, so that the session's does not count
    date = F.regexp_extract(F.trim(header), r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    at = F.try_to_timestamp(F.concat(date, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    dated = F.when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_millis(at) - now).cast("double")))
    by_header = F.coalesce(F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds * 1000)), dated)
    asked = F.regexp_extract(F.coalesce(message, F.lit("")), RETRY_DELAY, 1).try_cast("double") * 1000
    return F.when(header.isNotNull(), by_header).otherwise(asked)


def short_reason(status: Column, codes: Column, message: Column) -> Column:
    code = F.try_element_at(F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(status.cast("string"), code, F.substring(F.coalesce(message, F.lit("unknown error")), 1, 60))


class CallError(Exception):
    """A failed call with what decides about another try."""

    def __init__(self, message: str = "", status: int | None = None, code: str | None = None, retry_after: str | None = None) -> None:
        super().__init__(message)
        self.status, self.code, self.retry_after = status, code, retry_after


def _chain(error: BaseException):
    for _ in range(MAX_CAUSES):
        if error is None:
            return
        yield error
        error = error.__cause__


def transient(error: BaseException) -> bool:
    status = next((s for e in _chain(error) if isinstance(s := getattr(e, "status", None), int)), None)
    if status is not None:
        return status in TRANSIENT_STATUSES
    return any(getattr(e, "code", None) in TRANSIENT_CODES or isinstance(e, TimeoutError) for e in _chain(error))


def reason(error: BaseException) -> str:
    """Why a call failed, in short: a status, else a code, else the start of the message."""
    status = next((s for e in _chain(error) if isinstance(s := getattr(e, "status", None), int)), None)
    code = next((c for e in _chain(error) if isinstance(c := getattr(e, "code", None), str)), None)
    return str(status) if status is not None else code or (str(error) or "unknown error")[:60]


def server_delay_ms(error: BaseException, now: Callable[[], float] = time.time) -> float | None:
    header = getattr(error, "retry_after", None)
    if header is not None:
        try:
            return max(0.0, float(header) * 1000) if header.strip() else None
        except ValueError:
            try:
                return max(0.0, (parsedate_to_datetime(header).timestamp() - now()) * 1000)
            except ValueError:
                return None
    m = re.search(RETRY_DELAY, str(error))
    return float(m[1]) * 1000 if m else None


def with_retry(call: Callable, attempts: int = ATTEMPTS, base_ms: int = BASE_MS, max_ms: int = MAX_MS, sleep: Callable[[float], None] | None = None, random: Callable[[], float] = _random.random, log: Callable[[str], None] = lambda line: None, label: str = "model"):
    """The call's result; transient failures are tried again after a growing wait."""
    sleep = sleep or (lambda ms: time.sleep(ms / 1000))
    attempts = max(1, attempts)
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            asked = server_delay_ms(error)
            if attempt >= attempts or not transient(error) or (asked is not None and asked > MAX_SERVER_MS):
                raise
            backoff = min(max_ms, base_ms * 2 ** (attempt - 1))
            wait = asked if asked is not None else int(backoff / 2 + random() * backoff / 2 + 0.5)
            log(f"{label}: {reason(error)}, retrying in {wait / 1000:.1f}s (attempt {attempt + 1}/{attempts})")
            sleep(wait)
    raise AssertionError
