"""Order-book arithmetic on wide snapshots: bid_price_i, bid_volume_i, ask_price_i, ask_volume_i with i from 1.

All functions take and return Column expressions; a missing side or level propagates null unless stated otherwise.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import EPSILON, col, divide, log_ratio, quotient


def prices(side: str, n: int) -> list[Column]:
    return [F.col(f"{side}_price_{i}") for i in range(1, n + 1)]


def volumes(side: str, n: int) -> list[Column]:
    return [F.col(f"{side}_volume_{i}") for i in range(1, n + 1)]


def total(columns: list[Column], skip_null: bool = False) -> Column:
    """Sum of columns; null levels count as 0 if skip_null."""
    return reduce(add, [F.coalesce(c, F.lit(0.0)) for c in columns] if skip_null else columns)


def mean_present(columns: list[Column]) -> Column:
    """Mean of the columns that are not null."""
    return divide(total(columns, True), reduce(add, [c.isNotNull().cast("int") for c in columns]))


def mid(bid: Column | str = "bid_price_1", ask: Column | str = "ask_price_1") -> Column:
    return (col(bid) + col(ask)) / 2


def spread(bid: Column | str = "bid_price_1", ask: Column | str = "ask_price_1") -> Column:
    return col(ask) - col(bid)


def relative_spread(bid: Column | str = "bid_price_1", ask: Column | str = "ask_price_1", scale: float = 1.0) -> Column:
    """Spread by mid price; scale 1e4 for basis points, 100 for percent."""
    return divide(spread(bid, ask), mid(bid, ask)) * scale


def level_spread(level: int) -> Column:
    return F.col(f"ask_price_{level}") - F.col(f"bid_price_{level}")


def average_spread(n: int) -> Column:
    return total([level_spread(i) for i in range(1, n + 1)]) / n


def side_vwap(side: str, n: int) -> Column:
    return total([p * v for p, v in zip(prices(side, n), volumes(side, n))]) / (total(volumes(side, n)) + EPSILON)


def effective_spread(n: int) -> Column:
    """Volume-weighted ask less volume-weighted bid over n levels."""
    return side_vwap("ask", n) - side_vwap("bid", n)


def weighted_mid(bid: Column | str = "bid_price_1", ask: Column | str = "ask_price_1", bid_volume: Column | str = "bid_volume_1", ask_volume: Column | str = "ask_volume_1") -> Column:
    """Each price weighted by the other side's volume."""
    return (col(bid) * col(ask_volume) + col(ask) * col(bid_volume)) / (col(bid_volume) + col(ask_volume) + EPSILON)


def imbalance(bid: Column | str, ask: Column | str, method: str = "standard") -> Column:
    """standard: (b-a)/(b+a); ratio: b/a; log_ratio: its logarithm."""
    b, a = col(bid), col(ask)
    if method == "standard":
        return (b - a) / (b + a + EPSILON)
    if method == "ratio":
        return b / (a + EPSILON)
    if method == "log_ratio":
        return F.ln(b / (a + EPSILON))
    raise ValueError(f"unknown method {method!r}")


def depth(side: str, n: int) -> Column:
    """Volume of the first n levels; null levels count as 0."""
    return total(volumes(side, n), True)


def multi_level_imbalance(n: int) -> Column:
    return imbalance(depth("bid", n), depth("ask", n))


def decayed_imbalance(n: int, decay: float = 0.8) -> Column:
    """Imbalance of volumes weighted by decay^level."""
    weighted = lambda side: total([v * decay**i for i, v in enumerate(volumes(side, n), 1)])
    return imbalance(weighted("bid"), weighted("ask"))


def depth_ratio(n: int) -> Column:
    return depth("bid", n) / (depth("ask", n) + EPSILON)


def level_imbalance(level: int) -> Column:
    return imbalance(f"bid_volume_{level}", f"ask_volume_{level}")


def imbalance_gradient(near: int, far: int) -> Column:
    return level_imbalance(near) - level_imbalance(far)


def volume_difference(n: int, normalise: bool = False) -> Column:
    """Bid less ask volume over n levels, by their sum if normalise."""
    b, a = depth("bid", n), depth("ask", n)
    return (b - a) / (b + a + EPSILON) if normalise else b - a


def thickness(n: int, side: str = "both") -> Column:
    """Mean volume of the levels that are present; for both sides the mean of the two."""
    if side == "both":
        return (thickness(n, "bid") + thickness(n, "ask")) / 2
    return mean_present(volumes(side, n))


def thickness_ratio(n: int) -> Column:
    return thickness(n, "bid") / (thickness(n, "ask") + EPSILON)


def concentration(top: int, n: int, side: str = "both") -> Column:
    """Share of the first levels in the volume of n levels."""
    if side == "both":
        return (concentration(top, n, "bid") + concentration(top, n, "ask")) / 2
    return depth(side, top) / (depth(side, n) + EPSILON)


def concentrations(tops: tuple[int, ...], n: int, side: str = "both") -> dict[str, Column]:
    """Shares of several numbers of first levels, as columns."""
    return {f"concentration_{k}": concentration(k, n, side) for k in tops}


def book_features(levels: int, depths: tuple[int, ...] = (5, 10)) -> dict[str, Column]:
    """The features of a wide snapshot in one call: mid price, spreads, depth and imbalance at the best prices (null without volume), and the depth of the first levels of either side and of both, for the given numbers that there are levels for."""
    b, a = F.col("bid_volume_1"), F.col("ask_volume_1")
    out = {"mid_price": mid(), "quoted_spread": spread(), "relative_spread": relative_spread(), "depth_at_best": b + a, "depth_imbalance": divide((b - a).cast("double"), (b + a).cast("double"))}
    for n in depths:
        if n <= levels:
            out |= {f"cumulative_bid_depth_{n}": depth("bid", n), f"cumulative_ask_depth_{n}": depth("ask", n), f"cumulative_depth_{n}": depth("bid", n) + depth("ask", n)}
    return out


def concentration_asymmetry(top: int, n: int) -> Column:
    return concentration(top, n, "bid") - concentration(top, n, "ask")


def slope(side: str, n: int) -> Column:
    """Negated least-squares slope of ln(volume + 1) on the distance from the best price over the levels present; null under two levels."""
    best = F.col(f"{side}_price_1")
    x = [F.abs(p - best) for p in prices(side, n)]
    y = [F.ln(v + 1) for v in volumes(side, n)]
    here = [(a.isNotNull() & b.isNotNull()) for a, b in zip(x, y)]
    plus = lambda terms: total([F.when(h, t).otherwise(0.0) for h, t in zip(here, terms)])
    count = reduce(add, [h.cast("double") for h in here])
    sx, sy, sxx, sxy = plus(x), plus(y), plus([a * a for a in x]), plus([a * b for a, b in zip(x, y)])
    return F.when(best.isNotNull() & (count >= 2), -divide(count * sxy - sx * sy, count * sxx - sx * sx))


def nbbo(bid: str = "bid_price", ask: str = "ask_price", bid_size: str = "bid_size", ask_size: str = "ask_size") -> dict[str, Column]:
    """Best-quote features: mid, quoted and relative spread, basis points, weighted mid and order-flow imbalance."""
    b, a, bs, as_ = map(F.col, (bid, ask, bid_size, ask_size))
    return {
        "mid_price": (b + a) / 2,
        "quoted_spread": a - b,
        "relative_spread": divide(a - b, (b + a) / 2),
        "spread_bps": divide(a - b, (b + a) / 2) * 1e4,
        "weighted_mid_price": divide(b * as_ + a * bs, bs + as_),
        "order_flow_imbalance": divide((bs - as_).cast("double"), (bs + as_).cast("double")),
    }


def bar_features() -> dict[str, Column]:
    """Row features of bars open, high, low, close, vwap; quotients by a price of 0 are infinite or NaN."""
    o, h, low, c, v = map(F.col, ("open", "high", "low", "close", "vwap"))
    hl, co = log_ratio(h, low), log_ratio(c, o)
    variance = 0.5 * hl * hl - (2 * F.ln(F.lit(2.0)) - 1) * co * co
    return {
        "estimated_spread": h - low,
        "mid_price": (h + low) / 2,
        "relative_spread": quotient(h - low, (h + low) / 2),
        "typical_price": (h + low + c) / 3,
        "vwap_deviation": quotient(c - v, v),
        "price_range": quotient(h - low, c),
        "intrabar_momentum": quotient(c - o, o),
        "parkinson": F.sqrt(hl * hl / (4 * F.ln(F.lit(2.0)))),
        "garman_klass": F.when(variance >= 0, F.sqrt(variance)),
    }


def vwap_deviation(price: Column | str, vwap: Column | str, method: str = "absolute") -> Column:
    p, v = col(price), col(vwap)
    scale = {"relative": 1.0, "bps": 1e4}
    return p - v if method == "absolute" else divide(p - v, v) * scale[method]
