"""Resampling a dated measure: gaps, moving average, trend, anomalies, seasons."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profila.functions.text import quoted
from profila.operators.kernels import number, quantiles, settled

AGGREGATES = ("sum", "mean", "median", "min", "max", "count")
MAX_PERIODS = 5000
# --- fixed values: per frequency (name, date_trunc unit, step, window, unit word, days) ---
FREQUENCIES = {
    "D": ("Daily", "day", "1 day", 7, "day", 1),
    "W": ("Weekly", "week", "7 days", 4, "week", 7),
    "M": ("Monthly", "month", "1 month", 3, "month", 30),
    "Q": ("Quarterly", "quarter", "3 months", 4, "quarter", 91),
    "Y": ("Yearly", "year", "1 year", 3, "year", 365),
}
AUTO_LIMITS = [(92, "D"), (730, "W"), (365 * 15, "M")]  # longest span in days
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# -----------------------------------------------------------------------------------------


@dataclass
class TimeSeries:
    """A prepared series; every table it offers is bounded by the number of periods."""

    date: str
    value: str | None
    agg: str
    freq: str
    frame: DataFrame  # date, v: the rows used
    start: dt.datetime
    end: dt.datetime
    records: int
    missing_dates: int
    missing_values: int

    @property
    def span_days(self) -> int:
        return max((self.end - self.start).days, 0)

    @property
    def freq_label(self) -> str:
        return FREQUENCIES[self.freq][0]

    @property
    def window(self) -> int:
        return FREQUENCIES[self.freq][3]

    @property
    def ma_label(self) -> str:
        return f"{self.window}-{FREQUENCIES[self.freq][4]} moving average"

    def resample(self, freq: str | None = None) -> DataFrame:
        """(period, value, count) for every period between the first and the last.

        The rows are aggregated map-side, so only periods are shuffled. Empty periods are
        null, or 0 when counting.
        """
        _, unit, step, _, _, _ = FREQUENCIES[freq or self.freq]
        dated = self.frame.select(F.date_trunc(unit, "date").cast("date").alias("period"), "v")
        filled = dated.groupBy("period").agg(
            F.count("*").alias("count"), *_aggregate(self.agg))
        if self.agg == "median":
            medians = quantiles(dated, ["period"], "v", (0.5,)).select(
                "period", F.get("q", F.lit(0)).alias("value"))
            filled = filled.join(F.broadcast(medians), "period", "left")
        ends = [F.date_trunc(unit, F.lit(d)).cast("date") for d in (self.start, self.end)]
        spine = self.frame.sparkSession.range(1).select(
            F.explode(F.sequence(*ends, F.expr(f"interval {step}"))).alias("period"))
        value = F.coalesce("value", F.lit(0.0)) if self.agg == "count" else F.col("value")
        return spine.join(filled, "period", "left").select(
            "period", value.alias("value"), F.coalesce("count", F.lit(0)).alias("count"))

    @cached_property
    def periods(self) -> DataFrame:
        """The resampled series, settled: points, summary and anomalies share one scan."""
        return settled(self.resample())

    def points(self) -> DataFrame:
        """(period, value, ma, count): the series with its trailing moving average."""
        trailing = W.orderBy("period").rowsBetween(-(self.window - 1), 0)  # periods only
        return self.periods.select(
            "period", "value", F.avg("value").over(trailing).alias("ma"), "count")

    def summary(self) -> DataFrame:
        """One row: extent, gaps, peak, low, average and trend."""
        nth = F.row_number().over(W.partitionBy(F.col("value").isNull()).orderBy("period")) - 1
        pts = self.periods.withColumn("at", F.when(F.col("value").isNotNull(), nth))
        early = -F.datediff("period", F.lit("1970-01-01"))
        present = F.col("value").isNotNull()
        n, mean = F.col("periods_with_data"), F.col("average")
        slope = F.col("slope")
        change = slope * (n - 1) / F.coalesce(F.nullif(F.abs(mean), F.lit(0.0)), F.lit(1.0)) * 100
        base = pts.agg(
            F.count("*").alias("periods"), F.count("value").alias("periods_with_data"),
            F.count_if(F.col("count") == 0).alias("empty_periods"),
            F.max_by("period", F.when(present, F.struct("value", early))).alias("peak_period"),
            F.max("value").alias("peak_value"),
            F.max_by("period", F.when(present, F.struct(-F.col("value"), early))).alias("low_period"),
            F.min("value").alias("low_value"), F.avg("value").alias("average"),
            F.regr_slope("value", "at").alias("slope"),
            F.min_by("value", F.when(present, F.col("period"))).alias("first_value"),
            F.max_by("value", F.when(present, F.col("period"))).alias("last_value"))
        enough = n >= 3
        return base.select(
            "periods", "periods_with_data", "empty_periods",
            F.lit(self.start).cast("timestamp_ntz").alias("start"),
            F.lit(self.end).cast("timestamp_ntz").alias("end"),
            F.lit(self.span_days).alias("span_days"), F.lit(self.records).cast("long").alias("records_used"),
            F.lit(self.missing_dates).cast("long").alias("missing_dates"),
            F.lit(self.missing_values).cast("long").alias("missing_values"),
            "peak_period", "peak_value", "low_period", "low_value", "average",
            F.when(enough, F.when(F.abs(change) < 5, "roughly flat").when(slope > 0, "increasing")
                   .otherwise("decreasing")).alias("trend"),
            F.when(enough, slope).alias("trend_slope_per_period"),
            F.when(enough, change).alias("trend_change_pct_of_mean"),
            F.when(enough, F.col("first_value")).alias("first_value"),
            F.when(enough, F.col("last_value")).alias("last_value"),
            F.when(enough & (F.col("first_value") != 0),
                   (F.col("last_value") - F.col("first_value")) / F.abs("first_value") * 100
                   ).alias("first_to_last_pct"))

    def anomalies(self, limit: int | None = None) -> DataFrame:
        """(period, value, expected, direction): the periods far off the rolling median, all of them unless limited.

        All windows run over the present periods, which the calendar bounds.
        """
        w = self.window
        around = W.orderBy("period").rowsBetween(-w, w)
        whole = W.partitionBy()
        near = F.array_sort(F.collect_list("value").over(around))
        size = F.size(near)
        middle = (F.get(near, F.floor((size - 1) / 2).cast("int")) + F.get(near, F.floor(size / 2).cast("int"))) / 2
        resid = (
            self.periods.where("value is not null")
            .select("period", "value", F.when(size >= 3, middle).alias("expected"),
                    F.count("*").over(whole).alias("n"))
            .where("n >= 8").withColumn("resid", F.col("value") - F.col("expected")))
        off = resid.withColumn("off", F.col("resid") - F.percentile("resid", F.lit(0.5)).over(whole))
        spread = off.withColumns({
            "mad": F.percentile(F.abs("off"), F.lit(0.5)).over(whole),
            "mean": F.avg("resid").over(whole), "sd": F.stddev_samp("resid").over(whole)})
        robust = F.abs(0.6745 * F.col("off") / F.col("mad")) > 3.5
        plain = F.abs((F.col("resid") - F.col("mean")) / F.col("sd")) > 3.0
        far = F.when(F.col("mad") > 0, robust).when(F.col("sd") > 0, plain).otherwise(False)
        found = spread.where(far).select(
            "period", "value", "expected",
            F.when(F.col("resid") > 0, "above").otherwise("below").alias("direction")).orderBy("period")
        return found if limit is None else found.limit(limit)

    def season_month(self) -> DataFrame:
        """Mean of the monthly values per calendar month, from 12 months on."""
        return _season(self.resample("M"), F.month("period") - 1, MONTHS, 12, 1)

    def season_weekday(self) -> DataFrame:
        """Mean of the daily values per weekday, from 14 days on that cover all weekdays."""
        return _season(self.resample("D"), F.weekday("period"), WEEKDAYS, 14, 7)

    def season_hour(self) -> DataFrame:
        """The aggregate of the rows per hour of day, when there is more than one hour."""
        rows = self.frame.select(F.hour("date").alias("position"), "v")
        table = rows.groupBy("position").agg(*(_aggregate(self.agg) or [F.count("*").alias("n")]))
        if self.agg == "median":
            table = quantiles(rows, ["position"], "v", (0.5,)).select(
                "position", F.get("q", F.lit(0)).alias("value"))
        name = F.format_string("%02d:00", F.col("position"))
        return _with_peak(table.select(
            "position", name.alias("label"), "value", F.count("*").over(W.partitionBy()).alias("n"),
        ).where("n > 1").drop("n"))


def _aggregate(agg: str) -> list[Column]:
    forms = {"sum": F.sum("v"), "mean": F.avg("v"), "min": F.min("v"), "max": F.max("v"),
             "count": F.count("*").cast("double")}
    return [forms[agg].alias("value")] if agg in forms else []


def _season(periods: DataFrame, position: Column, names: list[str], least: int, groups: int) -> DataFrame:
    present = periods.where("value is not null").select(
        position.alias("position"), "value", F.count("*").over(W.partitionBy()).alias("n"))
    means = present.where(F.col("n") >= least).groupBy("position").agg(F.avg("value").alias("value"))
    enough = means.select("*", F.count("*").over(W.partitionBy()).alias("g")).where(F.col("g") >= groups)
    label = F.get(F.array(*map(F.lit, names)), F.col("position"))
    return _with_peak(enough.select("position", label.alias("label"), "value"))


def _with_peak(block: DataFrame) -> DataFrame:
    best = F.max(F.struct("value", (-F.col("position")).alias("neg"))).over(W.partitionBy())
    return block.select("*", (F.col("position") == -best["neg"]).alias("peak"))


def auto_frequency(span_days: int) -> str:
    return next((f for limit, f in AUTO_LIMITS if span_days <= limit), "Y")


def timeseries(
    df: DataFrame, date: str, value: str | None = None, agg: str = "sum", freq: str = "auto",
    max_periods: int | None = MAX_PERIODS,
) -> TimeSeries:
    """Prepare a series: check the arguments, count what is dropped, settle the frequency.

    ``max_periods`` refuses resolutions meant for no chart; None answers any.
    """
    if agg not in AGGREGATES:
        raise ValueError("Unknown aggregation.")
    if value is None:
        agg = "count"
    v = number(df, value) if value else F.lit(1.0)
    rows = df.select(F.col(quoted(date)).cast("timestamp_ntz").alias("date"), v.alias("v"))
    used = rows.where("date is not null and v is not null")
    s = rows.agg(
        F.count_if(F.col("date").isNull()).alias("no_date"),
        F.count_if(F.col("date").isNotNull() & F.col("v").isNull()).alias("no_value"),
        F.count_if(F.col("date").isNotNull() & F.col("v").isNotNull()).alias("n"),
        F.min(F.when(F.col("v").isNotNull(), F.col("date"))).alias("start"),
        F.max(F.when(F.col("v").isNotNull(), F.col("date"))).alias("end")).first()
    if s["n"] < 2:
        raise ValueError("Not enough rows with a valid date to build a time series.")
    span = max((s["end"] - s["start"]).days, 0)
    if freq == "auto":
        freq = auto_frequency(span)
    if freq not in FREQUENCIES:
        raise ValueError("Unknown frequency.")
    about = span / FREQUENCIES[freq][5]
    if max_periods is not None and about > max_periods:
        raise ValueError(
            f"{FREQUENCIES[freq][0]} resolution would create about {int(about):,} points. "
            "Choose a coarser frequency.")
    return TimeSeries(date, value, agg, freq, used, s["start"], s["end"], s["n"], s["no_date"], s["no_value"])
