"""Reading instants that are written in several forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions.text import strip

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
_ZONED = _ISO + r"\s?(Z|[+-]\d{2}:?\d{2})$"


def instant_ms(col: Column | str) -> Column:
    """Epoch milliseconds of a written instant, or null where it is missing or unreadable.

    ISO-8601 with ``T`` or a blank; without a zone it is UTC; a bare number is epoch milliseconds.
    """
    c = strip(col)
    # RE-anchored before the cast, as the cast alone would also take years, dates and times of day.
    iso = F.when(c.rlike(_ZONED), c).when(c.rlike(_ISO + "$"), F.concat(c, F.lit("Z")))
    return F.when(c.rlike(r"^-?\d{1,18}$"), c.try_cast("bigint")).otherwise(
        F.unix_millis(iso.try_cast("timestamp"))
    )


def epoch_ms(col: Column | str) -> Column:
    """Epoch milliseconds from a column that holds milliseconds or, in some rows, seconds (below 10**11)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.abs(c) < 100_000_000_000, c * 1000).otherwise(c)
