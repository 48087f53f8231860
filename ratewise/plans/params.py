"""Default parameters of the registered queries (dates are injected,
never read from the clock)."""

import datetime as dt

# Train / validation split of the feature store (data ends in 2001).
SPLIT_CUTOFF = dt.date(2000, 7, 1)
# First day priced by a recommendation run; the run is dated the same day.
RUN_DATE = SPLIT_CUTOFF
HORIZON = 30
# Effective date for rate lookups.
RATE_DATE = dt.date(2000, 1, 1)
# Executed-rental window used by the filter query.
FILTER_FROM = dt.date(1996, 1, 1)
FILTER_TO = dt.date(2000, 12, 31)
# Day whose fleet is on rent for the interval-overlap query.
ON_RENT_DATE = dt.date(2000, 6, 15)
# Horizon and window for holiday proximity features.
HOLIDAY_WINDOW_DAYS = 7
# Days whose prices are asked for at once (periods begin and end among them).
PRICED_FROM = dt.date(1999, 11, 15)
PRICED_TO = dt.date(2000, 1, 14)
