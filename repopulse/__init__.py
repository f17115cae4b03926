"""repopulse: DataFrame operators for software-repository metadata on Spark.

Landed result pages become one row per repository, one row becomes a set of
metrics with an explicit status, and the metric table is summarised, grouped,
correlated, reconciled with a second collection, stored and checked.
"""

from repopulse.session import build_session

__all__ = ["build_session"]
