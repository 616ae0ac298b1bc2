"""A panel of slots kept as the bars it is filled from: what follows from prices holds for all slots that a bar stands for.

A bar stands for its own slot and those up to the next bar, a day's first one for those before it too. Prices
are the same on all of them; flows (volumes, amounts) are zero but at the bar's own slot. So
columns and windows of prices are computed once a bar instead of once a slot, and the slots are laid out last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: A bar's own slot, the first and the last one that it stands for.
AT, FROM, TO = "_at", "_from", "_to"
KEYS = ("date", "instrument", "slot")
#: All bars of an instrument's day, in one row.
BARS = "_bars"
#: The slot whose turn it is, where a bar comes by once for each slot that it stands for.
TURN = "_turn"


def own(c: str) -> Column:
    """A flow in a slot: an observed NULL stays, only slots without a bar are zero."""
    return F.when(F.col("slot") == F.col(AT), F.col(c)).otherwise(0.0)


@dataclass(frozen=True)
class Spans:
    """bars: date, instrument, slot (the first one it stands for), AT, TO and the fields; flows: fields that are zero on slots without a bar.

    bars are dealt by date and instrument; by_instrument: the same ones dealt by instrument, as history is.
    """

    bars: DataFrame
    flows: tuple[str, ...]
    by_instrument: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.bars.columns if c not in (AT, TO)]

    def grid(self) -> DataFrame:
        """All slots."""
        return laid_out(self.bars).select(*KEYS, *[own(c).alias(c) if c in self.flows else F.col(c) for c in self.columns if c not in KEYS])


def laid_out(bars: DataFrame, turns: bool = False) -> DataFrame:
    """A row for each slot that a bar stands for, FROM beside it; turns: of bars that are `in_turn`, for the slot whose turn it is."""
    first, last = F.col(FROM), F.col(TO)
    if turns:
        first, last = F.greatest(first, F.col(TURN)), F.least(last, F.col(TURN))
    return bars.withColumnRenamed("slot", FROM).select("*", F.explode(F.sequence(first, last)).alias("slot"))


def in_turn(bars: DataFrame) -> DataFrame:
    """The bars once for each slot that they stand for, slot after slot, with TURN; those of a date are in one partition.

    So what needs a slot's whole cross-section finds its rows side by side, and only the bars were sorted, not the slots. A task holds the
    bars of one slot: those whose span has begun and is not over, as the bars go by in the order of their first slots.
    """
    schema = StructType([*bars.schema.fields, StructField(TURN, IntegerType())])

    def one(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        return some[0] if len(some) == 1 else pa.Table.from_batches(some).combine_chunks().to_batches()[0]

    def lasting(there: list[pa.RecordBatch], turn: int) -> list[pa.RecordBatch]:
        """What is not over, batch after batch (each old one goes as its rest is there), small rests put together."""
        out, small, rows = [], [], 0
        there.reverse()
        while there:
            b = there.pop()
            b = b.filter(pc.greater_equal(b.column(TO), turn))
            if b.num_rows:
                small.append(b)
                rows += b.num_rows
            if small and (rows >= 5_000 or not there):
                out.append(one(small))
                small, rows = [], 0
        return out

    def given(there: list[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for b in there:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, turn, dtype=np.int32))], [*b.schema.names, TURN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there: list[pa.RecordBatch] = []  # the bars of the date that are not over, as far as they have come by
        date, turn = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            dates = b.column("date").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            slots = b.column("slot").to_numpy(zero_copy_only=False)
            edges = (np.flatnonzero((dates[1:] != dates[:-1]) | (slots[1:] != slots[:-1])) + 1).tolist()
            for first, end in zip([0, *edges], [*edges, b.num_rows], strict=True):
                day, slot = b.column("date")[first].as_py(), int(slots[first])
                while there and (day != date or turn < slot):
                    there = lasting(there, turn)
                    yield from given(there, turn)
                    turn += 1
                there.append(b.slice(first, end - first))
                date, turn = day, slot
        while there:
            there = lasting(there, turn)
            yield from given(there, turn)
            turn += 1

    return bars.sortWithinPartitions("date", "slot").mapInArrow(run, schema)


def by_day(bars: DataFrame) -> DataFrame:
    """A row for each date and instrument, with BARS: no more of them than the day has slots.

    Gathered by a window, as bars have just been in its order: an aggregate would hash and sort them anew.
    """
    day = Window.partitionBy("instrument", "date").orderBy("slot")
    rest = F.struct(*[c for c in bars.columns if c not in ("date", "instrument")])
    whole = F.collect_list(rest).over(day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.select("date", "instrument", whole.alias(BARS), F.lag("slot").over(day).alias("_before")).where("_before IS NULL").drop("_before")


def with_bars(daily: DataFrame, days: DataFrame) -> DataFrame:
    """The daily rows, with the BARS of their day where there are any, dealt by instrument and in the order that windows over days need.

    So bars go to the days before hundreds of columns of history are computed there. Joined behind that, the history would
    cross an exchange, many times as wide as the bars. Where both are dealt by instrument into equally many partitions, their union is so too, and nothing is exchanged.
    """
    days = days.where("date IS NOT NULL AND instrument IS NOT NULL")  # a missing key meets nothing, as in a join
    both = daily.withColumn("_kind", F.lit(0)).unionByName(days.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    day = Window.partitionBy("instrument", "date").orderBy("_kind")
    return both.withColumn(BARS, F.lead(BARS).over(day)).where("_kind = 0").drop("_kind")


def by_bar(days: DataFrame) -> DataFrame:
    """A row for each of the BARS; days without any are dropped."""
    return days.select(*[c for c in days.columns if c != BARS], F.inline(BARS))
