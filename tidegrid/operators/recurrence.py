"""Running-day columns as recurrences: over a whole day at once, or resumed from the state that earlier rows left.

A recurrence says what it needs of the past in a few numbers: the first value, the last one, a sum,
an extreme, moments. `over_day` is its window over (instrument, date) by slot. `resumed` is the same
value when only new rows are there and the state that the rows before them left is a column of theirs;
`carried` is the state that a row leaves. Both are built-in expressions, so a batch and an online run
share every formula that reads them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.operators import windows
from tidegrid.operators.spans import AT, FROM, TO

#: Not null where a key has been seen before: the last slot that its state holds.
CURSOR = "_cursor"


def _held(name: str, part: str = "") -> str:
    return f"_z{part}_{name}"


@dataclass(frozen=True)
class Recurrence:
    """kind: first, change, sum, count, high, low, spread (population deviation), or whole (the day's future too); x: its input."""

    kind: str
    x: Column

    def over_day(self) -> Column:
        so_far = windows.so_far()
        match self.kind:
            case "first":
                return F.first(self.x).over(so_far)
            case "change":
                return windows.change(self.x)
            case "sum":
                return F.coalesce(F.sum(self.x).over(so_far), F.lit(0.0))
            case "count":
                return F.count(self.x).over(so_far).cast("double")
            case "high":
                return windows.high_so_far(self.x)
            case "low":
                return windows.low_so_far(self.x)
            case "spread":
                return F.stddev_pop(self.x).over(so_far)
            case "whole":
                return self.x
        raise ValueError(f"no recurrence is called {self.kind}")

    def over_spans(self, name: str, nature: str, of: str) -> tuple[dict[str, Column], Column | None]:
        """Columns of a day's bars, and from them the value in a slot of a span (none: it holds for the whole span).

        nature: of the input, `still` (the same on all slots of a span), `flow` (zero but at the bar's own slot) or `step` (the
        change of a still column `of`: zero but at the span's first slot). Zeros leave sums as they are and are counted.
        """
        so_far, slot, to, late = windows.so_far(), F.col("slot"), F.col(TO), F.col("slot") >= F.col(AT)
        match self.kind, nature:
            case ("first" | "high" | "low", "still") | ("sum", "step"):
                return {name: self.over_day()}, None
            case "change", "still":
                return {name: self.over_day()}, F.when(slot == F.col(FROM), F.col(name)).when(F.col(of).isNotNull(), 0.0)
            case "sum", "flow":
                return {name: self.over_day()}, F.when(late, F.col(name)).otherwise(0.0)
            case "count", "step":
                quiet = F.col(of).isNotNull().cast("double")
                return {name: F.sum(self.x.isNotNull().cast("double") + quiet * (to - slot)).over(so_far)}, F.col(name) - quiet * (to - slot)
            case "count", "flow":
                there = self.x.isNotNull().cast("double")
                return {name: F.sum(there + (to - slot)).over(so_far), f"_a{name}": there}, F.col(name) - (to - slot) + F.when(late, 0.0).otherwise(1 - F.col(f"_a{name}"))
            case "spread", "flow":
                n, mean, square = F.col(f"_n{name}"), F.col(f"_e{name}"), F.col(f"_q{name}")
                made = {f"_n{name}": F.count(self.x).over(so_far), f"_b{name}": F.row_number().over(windows.today()), f"_e{name}": F.avg(self.x).over(so_far), f"_q{name}": F.var_pop(self.x).over(so_far)}
                zeros = slot + 1 - F.col(f"_b{name}")
                both = F.when(n == 0, 0.0).otherwise(square * n + mean * mean * n * zeros / (n + zeros))
                return made, F.when(~late, 0.0).when(n + zeros > 0, F.sqrt(both / (n + zeros)))
        raise ValueError(f"{name}: no {self.kind} of a {nature} column over spans")

    def parts(self) -> tuple[str, ...]:
        """Names of the numbers (or flags) that its state holds."""
        return {"high": ("", "broken"), "low": ("", "broken"), "spread": ("n", "mean", "square")}.get(self.kind, ("",))

    def _moments(self, name: str) -> tuple[Column, Column, Column]:
        """Count, mean and sum of squared deviations of the state and the new rows together."""
        so_far = windows.so_far()
        n0, m0, q0 = (F.coalesce(F.col(_held(name, p)), F.lit(0.0)) for p in ("n", "mean", "square"))
        n1 = F.count(self.x).over(so_far).cast("double")
        m1 = F.coalesce(F.avg(self.x).over(so_far), F.lit(0.0))
        q1 = F.coalesce(F.var_pop(self.x).over(so_far), F.lit(0.0)) * n1
        n = n0 + n1
        off = m1 - m0
        return n, F.coalesce(m0 + F.try_divide(off * n1, n), F.lit(0.0)), q0 + q1 + F.coalesce(F.try_divide(off * off * n0 * n1, n), F.lit(0.0))

    def _broken(self, name: str) -> Column:
        so_far = windows.so_far()
        return F.coalesce(F.col(_held(name, "broken")), F.lit(False)) | (F.count(self.x).over(so_far) < F.count(F.lit(1)).over(so_far))

    def resumed(self, name: str) -> Column:
        so_far, held, seen = windows.so_far(), F.col(_held(name, self.parts()[0])), F.col(CURSOR).isNotNull()
        match self.kind:
            case "first":
                return F.when(seen, held).otherwise(F.first(self.x).over(so_far))
            case "change":
                first = F.row_number().over(windows.today()) == 1
                return F.when(first, F.when(seen, self.x - held).otherwise(self.x)).otherwise(self.x - F.lag(self.x, 1).over(windows.today()))
            case "sum":
                return F.coalesce(held, F.lit(0.0)) + F.coalesce(F.sum(self.x).over(so_far), F.lit(0.0))
            case "count":
                return F.coalesce(held, F.lit(0.0)) + F.count(self.x).over(so_far)
            case "high":
                return F.when(~self._broken(name), F.greatest(held, F.max(self.x).over(so_far)))
            case "low":
                return F.when(~self._broken(name), F.least(held, F.min(self.x).over(so_far)))
            case "spread":
                n, _, square = self._moments(name)
                return F.when(n > 0, F.sqrt(square / n))
        raise ValueError(f"{name} needs the rest of the day: it is a target, not an online factor")

    def carried(self, name: str) -> dict[str, Column]:
        """The state that a row leaves, from its columns (the recurrence's own value among them)."""
        match self.kind:
            case "change":
                return {_held(name): self.x}
            case "high" | "low":
                return {_held(name): F.col(name), _held(name, "broken"): self._broken(name)}
            case "spread":
                return dict(zip((_held(name, p) for p in self.parts()), self._moments(name), strict=True))
        return {_held(name): F.col(name)}
