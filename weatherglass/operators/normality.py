"""A station's normal pattern: mean and spread per month, hour and channel, and readings judged against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import long_form
from ..settings import CHANNELS, DEFAULT, Settings


def fit(readings: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Cells (station, month, hour, channel: mean, population std, n) with enough samples. One partial and one final
    aggregation; the result has at most 864 rows a station."""
    long = long_form(readings, "station_id", "ts").filter("value IS NOT NULL")
    cells = long.groupBy("station_id", F.month("ts").alias("month"), F.hour("ts").alias("hour"), "channel").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
    return cells.filter(F.col("n") >= settings.normality.min_samples)


#: Places in a station's array of cells: month * 24 + hour.
PLACES = 13 * 24


def by_place(cells: DataFrame) -> DataFrame:
    """One row a station: cells_<channel>, an array with the cell (mean, std) of each place, null where there is none."""
    entry = F.struct((F.col("month") * 24 + F.col("hour")).alias("key"), F.struct("mean", "std").alias("value"))
    maps = cells.groupBy("station_id").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("channel") == c, entry))).alias(f"map_{c}") for c in CHANNELS])

    def listed(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda k: F.try_element_at(F.col(f"map_{c}"), k))

    return maps.select("station_id", *[listed(c).alias(f"cells_{c}") for c in CHANNELS])


def cell(channel: str, month: Column, hour: Column) -> Column:
    return F.get(F.col(f"cells_{channel}"), month * 24 + hour)


def attach(readings: DataFrame, cells: DataFrame) -> DataFrame:
    """readings with the cells of their station. Spark broadcasts these only if they are small."""
    return readings.join(by_place(cells), "station_id", "left")


def expected_cell(channel: str, ts: str = "ts") -> Column:
    return cell(channel, F.month(ts), F.hour(ts))


#: Helper columns of corners(): the places of the four cells around a time, and their weights.
CORNERS = tuple(f"corner_{x}{k}" for x in "kw" for k in range(4))


def corners(ts: str = "ts") -> dict[str, Column]:
    """The four cells around a time: neighbouring hours by the minute, and neighbouring middles of months by day and hour.
    Computed once a row, for all channels."""
    month, hour, part = F.month(ts), F.hour(ts), F.minute(ts) / 60.0
    place = (F.dayofmonth(ts) - 0.5 + hour / 24.0) / F.dayofmonth(F.last_day(ts))
    late = place >= 0.5
    first = F.when(late, month).otherwise(F.pmod(month - 2, F.lit(12)) + 1)
    second = F.when(late, F.pmod(month, F.lit(12)) + 1).otherwise(month)
    share = F.when(late, place - 0.5).otherwise(place + 0.5)
    after = F.pmod(hour + 1, F.lit(24))
    found = [(m * 24 + h, wm * wh) for m, wm in ((first, 1.0 - share), (second, share)) for h, wh in ((hour, 1.0 - part), (after, part))]
    return dict(zip(CORNERS, [k for k, _ in found] + [w for _, w in found], strict=True))


def smooth_expected(channel: str) -> Column:
    """The expected value without steps: the weighted mean of the corner cells that exist. Needs the columns of corners()."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for k in range(4):
        mean, w = F.get(F.col(f"cells_{channel}"), F.col(f"corner_k{k}"))["mean"], F.col(f"corner_w{k}")
        total, weight = total + F.coalesce(w * mean, F.lit(0.0)), weight + F.when(mean.isNotNull(), w).otherwise(0.0)
    return total / F.nullif(weight, F.lit(0.0))


def centred(channel: str, ts: Column) -> tuple[Column, Column]:
    """(mean, std) read at the middle of each hour and interpolated between neighbouring hours."""
    centre = F.date_trunc("HOUR", ts).cast("timestamp_ntz") + F.expr("INTERVAL 30 MINUTE")
    other_ts = F.when(ts >= centre, ts + F.expr("INTERVAL 1 HOUR")).otherwise(ts - F.expr("INTERVAL 1 HOUR"))
    here, other = cell(channel, F.month(ts), F.hour(ts)), cell(channel, F.month(other_ts), F.hour(other_ts))
    w = F.abs(F.timestamp_diff("MICROSECOND", centre, ts)) / 3.6e9

    def mix(name: str) -> Column:
        return F.when(other.isNull(), here[name]).otherwise((1 - w) * here[name] + w * other[name])

    return mix("mean"), mix("std")
