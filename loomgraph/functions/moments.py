"""Moments as people write them: ISO times, dates, yesterday, last week, 3 days ago, 30d."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

# Days in each relative phrase.
PHRASES = {"yesterday": 1, "last week": 7, "last month": 30, "last year": 365}
UNITS = {"minute": 1 / 1440, "hour": 1 / 24, "day": 1, "week": 7, "month": 30, "year": 365}
SHORT = {"s": 1 / 86400, "m": 1 / 1440, "h": 1 / 24, "d": 1, "w": 7, "M": 30, "y": 365}


class InvalidMoment(ValueError):
    pass


def resolve(text: str, now: datetime, short: bool = False) -> datetime:
    """The moment meant, in UTC. A moment in the future is an error, as is anything unknown; short also allows 30d, 2w, 6M."""
    t = text.strip()
    if short and (m := re.fullmatch(r"(\d+)([smhdwMy])", t)):
        return now - timedelta(days=int(m[1]) * SHORT[m[2]])
    low = t.lower()
    if low in PHRASES:
        return now - timedelta(days=PHRASES[low])
    if m := re.fullmatch(r"(\d+)\s+(minute|hour|day|week|month|year)s?\s+ago", low):
        return now - timedelta(days=int(m[1]) * UNITS[m[2]])
    if re.fullmatch(r"\d{4}-\d\d-\d\d", t):
        t += "T00:00:00+00:00"
    elif not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)", t):
        raise InvalidMoment(f"not a moment: {text!r}")
    try:
        found = datetime.fromisoformat(t.replace("Z", "+00:00")).astimezone(timezone.utc)
    except ValueError as e:
        raise InvalidMoment(f"not a moment: {text!r}") from e
    if found > now:
        raise InvalidMoment(f"in the future: {text!r}")
    return found
