"""churnlens: user-churn analytics written as Spark DataFrame and pyspark.ml jobs.

Sub-packages
------------
sources    scans, sinks and the mapping from the driver tables to the logical tables
functions  column expressions and scalable ranking helpers
operators  feature, scoring, split, metric, neighbour and clustering operators
plans      model pipelines, tuning, selection sweeps, stacking, the end-to-end job
streaming  incremental scoring of newly arriving feature partitions
"""

__version__ = "0.1.0"
