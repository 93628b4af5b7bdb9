"""Which failures to try again, and after how long."""

from __future__ import annotations

import random
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTTP statuses and the service's own codes, by what they call for.
FINAL_STATUS = (400, 401, 403, 404, 422)
RETRY_STATUS = (429, 500, 502, 503, 504)
RATE_LIMIT, OVERLOAD, EMPTY_REPLY = 1302, 1305, 1300
TRANSIENT = (1200, 1230, 1234)
QUOTA = (1308, 1310, 1316, 1317, 1318, 1319, 1320, 1321)
CONTENT_FILTER = (1301,)
RETRY_CODES = (RATE_LIMIT, OVERLOAD, *TRANSIENT, EMPTY_REPLY)
UPLOAD_RETRY_CODES = ("RATE_LIMIT", "INTERNAL_ERROR", "PARTIAL_UPLOAD_NOT_COMMITTED")


# Seconds before the first further attempt, by what was reported, the longest wait, and the part by which chance may stretch one.
FIRST_WAIT, OTHER_FIRST_WAIT = {RATE_LIMIT: 10.0, OVERLOAD: 30.0}, 2.0
LONGEST_WAIT, STRETCH = 300.0, 0.3


class Patience(NamedTuple):
    """How often to try again, by what each further wait grows, and what lies between two requests at least; stretch: of waits, by chance."""

    more: int = 2
    growth: float = 2.0
    gap: float = 3.0
    stretch: float = STRETCH

    def wait(self, attempt: int, code: int | str | None = None) -> float:
        """Seconds after a failed attempt (from 0)."""
        plain = min(FIRST_WAIT.get(code, OTHER_FIRST_WAIT) * self.growth**attempt, LONGEST_WAIT)
        return min(plain * (1 + random.uniform(0, self.stretch)), LONGEST_WAIT)

    def between(self) -> float:
        """Seconds between two requests."""
        return max(self.gap, 0.0) * (1 + random.uniform(0, self.stretch))


def worth_retrying(code: int | str | None, failed: bool = False) -> bool:
    """What is_retryable says of columns."""
    if code in (*FINAL_STATUS, *QUOTA, *CONTENT_FILTER):
        return False
    return failed or code in (*RETRY_STATUS, *RETRY_CODES)


def is_retryable(status: Column, failed: Column) -> Column:
    """Statuses first, then any exception."""
    return F.when(F.coalesce(status.isin(*FINAL_STATUS, *QUOTA, *CONTENT_FILTER), F.lit(False)), False).when(F.coalesce(status.isin(*RETRY_STATUS, *RETRY_CODES), F.lit(False)), True).otherwise(failed)


def is_rate_limit(status: Column) -> Column:
    return F.coalesce(status.isin(RATE_LIMIT, OVERLOAD), F.lit(False))


def is_overload(status: Column) -> Column:
    return F.coalesce(status == OVERLOAD, F.lit(False))


def backoff(attempt: Column, status: Column, growth: float = Patience().growth, jitter: bool = False) -> Column:
    """Seconds before a further attempt (from 0); with jitter longer by STRETCH at most, never beyond the longest wait."""
    start = F.coalesce(*(F.when(status == code, wait) for code, wait in FIRST_WAIT.items()), F.lit(OTHER_FIRST_WAIT))
    wait = F.least(start * F.pow(F.lit(growth), attempt), F.lit(LONGEST_WAIT))
    return F.least(wait * (1 + F.rand() * STRETCH), F.lit(LONGEST_WAIT)) if jitter else wait


def upload_retryable(status: Column, code: Column) -> Column:
    return (status != 200) & ((status == 429) | (status >= 500) | F.coalesce(code.isin(*UPLOAD_RETRY_CODES), F.lit(False)))


def upload_delay(attempt: Column, retry_after: Column) -> Column:
    """What the service asks for if that is positive, else doubling from 2 s; 60 s at most."""
    return F.least(F.coalesce(F.when(retry_after > 0, retry_after), F.lit(2.0) * F.pow(F.lit(2.0), attempt)), F.lit(60.0))
