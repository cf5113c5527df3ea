"""Time columns: mtime values come as Unix seconds, Unix milliseconds, or 100-ns ticks since 1601-01-01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks per second, and the Unix epoch in ticks since 1601-01-01.
TICKS_PER_SECOND = 10_000_000
UNIX_EPOCH_TICKS = 116_444_736_000_000_000
#: All values above these are ticks, or else milliseconds.
TICKS_ABOVE, MILLISECONDS_ABOVE = 10**13, 10**10


def unix_seconds(mtime: Column) -> Column:
    """Whole Unix seconds (rounded down) of an mtime in any of the units; null stays null."""
    ticks = mtime - F.lit(UNIX_EPOCH_TICKS)
    # whole numbers throughout: ticks have more digits than a double
    floored = F.call_function("div", ticks - F.pmod(ticks, F.lit(TICKS_PER_SECOND)), F.lit(TICKS_PER_SECOND))
    from_milliseconds = F.call_function("div", mtime, F.lit(1000)).cast("bigint")
    return F.when(mtime > F.lit(TICKS_ABOVE), floored.cast("bigint")).when(mtime > F.lit(MILLISECONDS_ABOVE), from_milliseconds).otherwise(mtime)
