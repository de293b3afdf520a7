"""Time-of-day and trading-session features of wall-clock timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

#: Latest minute after the open of each part of the session, in order.
PARTS = ((30, "open"), (120, "mid_morning"), (240, "lunch"), (330, "afternoon"), (390, "close"))


def time_features(ts: Column | str) -> dict[str, Column]:
    t = col(ts)
    hour, minute = F.hour(t), F.minute(t)
    angle = lambda x, n: x * (2 * math.pi / n)
    return {
        "hour": hour,
        "minute": minute,
        "seconds_since_midnight": hour * 3600 + minute * 60 + F.second(t),
        "hour_sin": F.sin(angle(hour, 24)),
        "hour_cos": F.cos(angle(hour, 24)),
        "minute_sin": F.sin(angle(minute, 60)),
        "minute_cos": F.cos(angle(minute, 60)),
    }


def session_features(ts: Column | str, opens: int = 9 * 3600 + 1800, closes: int = 16 * 3600) -> dict[str, Column]:
    """Minutes from the open and to the close, progress, whether the market is open (ends included), and the part of the session."""
    t = col(ts)
    second = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    since = (second - opens) / 60.0
    part = F.when(since < 0, "pre_open")
    for end, name in PARTS:
        part = part.when(since <= end, name)
    return {
        "minutes_since_open": since,
        "minutes_until_close": (closes - second) / 60.0,
        "session_progress": since / ((closes - opens) / 60.0),
        "is_market_hours": (second >= opens) & (second <= closes),
        "session_part": part.otherwise("post_close"),
    }
