"""Column-level helpers: calendar date arithmetic, as-of bounds, ordered rules, conditional counts."""

from fleetcases.functions.dates import (as_of_filter, day_diff, day_of, day_span, days_inclusive,
                                        earlier_of, min_day, year_diff)
from fleetcases.functions.rules import (TV_MAKER_RULES, classify_first_match, conditional_count,
                                        conditional_count_distinct)

__all__ = ["as_of_filter", "day_diff", "day_of", "day_span", "days_inclusive", "earlier_of",
           "min_day", "year_diff", "TV_MAKER_RULES", "classify_first_match", "conditional_count",
           "conditional_count_distinct"]
