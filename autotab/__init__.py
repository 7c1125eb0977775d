"""autotab: table profiling, preparation, modelling and scoring as Spark jobs.

Every public operator takes and returns a Spark DataFrame (or a fitted
``pyspark.ml`` model). Heavy work runs on executors; the driver only ever
holds bounded summaries (one row per column, class, cluster or parameter).
"""

__version__ = "0.1.0"
