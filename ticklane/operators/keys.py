"""How rows of a time series are identified and ordered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec


@dataclass(frozen=True)
class Keys:
    """Columns of the series' name, its time, and a number that orders rows of equal time."""

    symbol: str = "symbol"
    ts: str = "ts"
    seq: str = "seq"

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(self.symbol).orderBy(self.ts, self.seq)

    def last(self, rows: int) -> WindowSpec:
        """The current row and the rows-1 before it."""
        return self.ordered().rowsBetween(-(rows - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def earlier(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, -1)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(self.symbol)


KEYS = Keys()
