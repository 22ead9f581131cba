"""Device side: one-second samples filtered and averaged into minutes with flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import dew_point
from ..settings import CHANNELS, DEFAULT, Settings


def minutes(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, minute, values, flags) of samples (station_id, ts, values): a value needs enough samples in range; flags
    in the order range, few_valid, frozen, dew_point. A missing minute breaks a frozen run; means compare as floats."""
    new = [F.count("*").alias("samples")]
    for c in CHANNELS:
        good = F.col(c).between(s.physics.low[c], s.physics.high[c]) & ~F.isnan(c)
        new += [F.count_if(good).alias(f"n_{c}"), F.count_if(F.col(c).isNotNull() & ~F.isnan(c) & ~good).alias(f"bad_{c}"), F.avg(F.when(good, F.col(c))).alias(f"mean_{c}")]
    closed = samples.groupBy("station_id", F.date_trunc("MINUTE", "ts").cast("timestamp_ntz").alias("minute")).agg(*new)
    out = closed.withColumns({c: F.when(F.col(f"n_{c}") >= max(1, s.edge.min_valid), F.col(f"mean_{c}").cast("float")) for c in CHANNELS})
    order = Window.partitionBy("station_id").orderBy("minute")
    for c in CHANNELS:
        apart = (F.col("minute") - F.expr("INTERVAL 1 MINUTE")) != F.lag("minute").over(order)
        fresh = F.coalesce((F.col(c) != F.lag(c).over(order)) | apart, F.lit(True)) | F.col(c).isNull()
        out = out.withColumn(f"new_{c}", fresh.cast("int")).withColumn(f"island_{c}", F.sum(f"new_{c}").over(order))
    for c in CHANNELS:
        run = F.row_number().over(Window.partitionBy("station_id", f"island_{c}").orderBy("minute"))
        out = out.withColumn(f"run_{c}", F.when(F.col(c).isNotNull(), run).otherwise(0))
    wet = (F.col("humidity_pct") > 0) & (dew_point(F.col("temperature_c").cast("double"), F.col("humidity_pct").cast("double")) > F.col("temperature_c") + s.physics.dew_tolerance)
    flags = [F.when(F.col(f"bad_{c}") > 0, F.lit(f"range:{c}")) for c in CHANNELS]
    flags += [F.when(F.col(c).isNull(), F.lit(f"few_valid:{c}")) for c in CHANNELS]
    flags += [F.when(F.col(f"run_{c}") >= s.edge.frozen_minutes, F.lit(f"frozen:{c}")) for c in CHANNELS] if s.edge.frozen_minutes > 0 else []
    return out.select("station_id", "minute", "samples", *CHANNELS, F.array_compact(F.array(*flags, F.when(wet, F.lit("dew_point")))).alias("flags"))
