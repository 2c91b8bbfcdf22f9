"""Date text in the formats of membership tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted layouts, in the order they are tried.
DATE_LAYOUTS = ("MMMM d, yyyy", "yyyy-M-d", "d MMMM yyyy", "MMM d, yyyy")
# Texts that mean "no date".
NO_DATE_TEXTS = ("", "nan", "—", "-")


def parse_date(text: Column) -> Column:
    """A date in one of the known layouts; a bare year gives its first day; anything else null."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    tries = [F.try_to_timestamp(clean, F.lit(layout)).cast("date") for layout in DATE_LAYOUTS]
    year = F.when(clean.rlike(r"^\d{1,4}$") & (clean.try_cast("int") > 0), F.make_date(clean.try_cast("int"), F.lit(1), F.lit(1)))
    return F.when(~F.lower(clean).isin(*NO_DATE_TEXTS), F.coalesce(*tries, year))
