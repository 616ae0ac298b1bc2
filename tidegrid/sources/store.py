"""The panel store: partitioned Parquet folders with date partitions, one folder for each variable.

Layout: root/quotation, root/prediction/<model>/<epoch>[_ema], root/factor/<name>, root/daily. Each
but daily is partitioned by date, so a date filter prunes files and rewriting a date replaces just
that partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators.panel import adjusted, between, missing_dates, with_more_rows_than


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a single machine the warehouse serves."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str):
    """Adds a way to read a variable's folder: a function of (spark, path) to a lazy frame."""

    def put(f):
        if name in SOURCES:
            raise ValueError(f"source {name} is registered already")
        SOURCES[name] = f
        return f

    return put


for _format in ("parquet", "orc"):
    register_source(_format)(lambda spark, path, f=_format: spark.read.format(f).load(path))


@dataclass(frozen=True)
class Variable:
    """What to read: kind is quotation, prediction, factor or daily; source is the registered way to read and write it."""

    kind: str
    name: str = ""
    epoch: int = 0
    ema: bool = False
    fields: tuple[str, ...] = field(default=())
    source: str = "parquet"


@dataclass
class PanelStore:
    spark: SparkSession
    root: str
    compression: str = "zstd"

    def path(self, v: Variable) -> str:
        parts = {
            "quotation": ["quotation"],
            "prediction": ["prediction", v.name, f"epoch{v.epoch:02d}" + "_ema" * v.ema],
            "factor": ["factor", v.name],
            "daily": ["daily"],
        }
        if v.kind not in parts:
            raise ValueError(f"no kind of variable is called {v.kind}")
        return "/".join([self.root.rstrip("/"), *parts[v.kind]])

    def exists(self, v: Variable) -> bool:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path(v))
        return path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)

    def read(self, v: Variable) -> DataFrame:
        if v.source not in SOURCES:
            raise ValueError(f"no source is called {v.source}")
        return SOURCES[v.source](self.spark, self.path(v))

    def load(self, v: Variable, start=None, end=None, instruments: Sequence | None = None) -> DataFrame:
        """Rows of the dates and instruments asked for; the filters reach the scan and columns are pruned."""
        df = between(self.read(v), start, end)
        if instruments is not None:
            df = df.where(F.col("instrument").isin(list(instruments)))
        if v.fields:
            df = df.select(*dict.fromkeys(c for c in ("date", "instrument", "slot", *v.fields) if c in df.columns))
        return df

    def save(self, v: Variable, df: DataFrame, overwrite: bool = False) -> None:
        """Writes date partitions; without overwrite an existing date is an error, with it just these dates are replaced."""
        if v.kind == "daily":
            df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", self.compression).format(v.source).save(self.path(v))
            return
        if not overwrite and self.exists(v):
            clash = self.dates(v).join(df.select("date").distinct(), "date", "left_semi").take(1)
            if clash:
                raise FileExistsError(f"{self.path(v)} has {clash[0].date}")
        out = df.repartition("date").write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic")
        out.option("compression", self.compression).partitionBy("date").format(v.source).save(self.path(v))

    def dates(self, *vs: Variable) -> DataFrame:
        """Dates that all of the variables have, in order; none if one has no folder."""
        if not all(self.exists(v) for v in vs):
            return self.spark.createDataFrame([], "date date")
        each = [self.read(v).select(F.col("date").cast("date").alias("date")).distinct() for v in vs]
        return reduce(DataFrame.intersect, each).orderBy("date")

    def todo(self, inputs: Sequence[Variable], output: Variable) -> DataFrame:
        """Dates that the inputs have and the output lacks."""
        have = self.dates(*inputs)
        return have if not self.exists(output) else missing_dates(have, self.dates(output))

    def quotation(self, start=None, end=None, instruments: Sequence | None = None) -> DataFrame:
        """Intraday bars with total_volume, the running volume of each instrument and day."""
        df = self.load(Variable("quotation"), start, end, instruments)
        w = Window.partitionBy("instrument", "date").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("total_volume", F.sum("volume").over(w))

    def prediction_with_quotation(self, v: Variable, start=None, end=None) -> DataFrame:
        return self.load(v, start, end).join(self.load(Variable("quotation"), start, end), ["date", "instrument", "slot"], "left")

    def daily(self, start=None, end=None, instruments: Sequence | None = None, fields: Sequence[str] = ()) -> DataFrame:
        """Daily bars; adjusted_x asks for x and the factor, a missing alpha takes the return."""
        df = self.load(Variable("daily"), start, end, instruments)
        if "alpha" in df.columns and "daily_return" in df.columns:
            df = df.withColumn("alpha", F.coalesce("alpha", "daily_return"))
        raw = dict.fromkeys(f.removeprefix("adjusted_") for f in fields)
        return df.select("date", "instrument", *dict.fromkeys([*raw, "factor"])) if fields else df

    def daily_before(self, day, calendar_days: int = 365, fields: Sequence[str] = ("close",), include: bool = False) -> DataFrame:
        """The calendar days before a day, prices adjusted to the last factor up to and with it."""
        start = F.date_sub(F.lit(day).cast("date"), calendar_days)
        df = self.daily(fields=fields).where((F.col("date") >= start) & (F.col("date") <= F.lit(day).cast("date")))
        out = adjusted(df, list(fields), last=True)
        return out if include else out.where(F.col("date") < F.lit(day).cast("date"))

    def recent(self, day, rows: int, calendar_days: int, fields: Sequence[str] = ("close",)) -> DataFrame:
        """The days before a day of instruments with more than `rows` rows in the calendar days before it."""
        return with_more_rows_than(self.daily_before(day, calendar_days, fields), rows)

    def daily_after(self, day, calendar_days: int = 21, fields: Sequence[str] = ("close",)) -> DataFrame:
        end = F.date_add(F.lit(day).cast("date"), calendar_days)
        df = self.daily(fields=fields).where((F.col("date") >= F.lit(day).cast("date")) & (F.col("date") <= end))
        return adjusted(df, list(fields), last=False)
