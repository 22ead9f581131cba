"""What a verdict rests on, in words and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CHANNELS

#: Of each kind of check: words before and after its number, the number's digits, and whether it is the channel's own value.
SAID = {
    "range": ("is ", ", outside its possible range", 1, True),
    "dew_point": ("dew point of ", " lies above the temperature", 1, False),
    "wet_bulb": ("wet-bulb temperature of ", " is beyond what is survivable", 1, False),
    "timestamp": ("time stamp does not follow the one before", "", None, False),
    "dropout": ("", " of the values missing", 0, False),
    "gap": ("", " minutes without a reading", 0, False),
    "limits": ("learned limits are incomplete or for another cadence", "", None, False),
    "frozen": ("has kept within ", " for all of its window", 2, False),
    "step": ("changed by ", " at once", 1, False),
    "spike": ("went out and came back to ", "", 1, True),
    "noise": ("jitters by ", ", more than it ever should", 2, False),
    "drift": ("has crept away, to a sum of ", "", 1, False),
    "offset": ("stands off by a median of ", " deviations, the others do not", 1, False),
    "clock": ("the course of the day fits another hour better", "", None, False),
    "cojump": ("", " channels jumped together", 0, False),
    "normality": ("is ", " deviations from normal", 1, False),
    "isolation_forest": ("values and rates are a rare mix, with a score of ", "", 3, False),
    "mahalanobis": ("departures and rates are an unusual mix, at a squared distance of ", "", 1, False),
}


def number(x: Column, digits: int) -> Column:
    """x with so many digits; huge ones have no text."""
    return F.coalesce(F.round(x, digits).try_cast(f"decimal(28,{digits})").cast("string"), F.lit("some amount"))


def said(check: Column) -> Column:
    """A flagged check (a struct) as a clause, with its channel and its number."""
    own = F.lit(None).cast("double")
    for c in CHANNELS:
        own = F.when(check["channel"] == c, F.col(c)).otherwise(own)
    out = F.concat(check["kind"], F.lit(" is unusual"))
    for kind, (before, after, digits, of_channel) in SAID.items():
        told = F.lit(before + after) if digits is None else F.concat(F.lit(before), number(own if of_channel else check["value"], digits), F.lit(after))
        out = F.when(check["kind"] == kind, told).otherwise(out)
    return F.concat_ws(" ", check["channel"], out)


def clauses(checks: Column) -> Column:
    return F.array_join(F.transform(checks, said), "; ")
