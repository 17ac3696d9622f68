"""ballotlens: shareholder-voting analytics as composable Spark DataFrame functions.

Every public function takes DataFrames (plus plain Python parameters) and returns
DataFrames built from Spark's built-in expressions, so Catalyst can prune columns,
push filters into the Parquet scan and plan partial (map-side) aggregation.
"""

__version__ = "0.1.0"
