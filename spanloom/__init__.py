"""Spark-native analytics over agent telemetry.

Every public function takes DataFrames (or Columns) and returns DataFrames
(or Columns).  Nothing reads the wall clock: functions that need "now" take
an ``asof`` argument, so a job can be rerun for any day with the same result.
"""

__version__ = "0.1.0"
