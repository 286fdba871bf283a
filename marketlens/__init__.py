"""marketlens: product, market and experiment analytics as lazy Spark DataFrame operators.

Layout
  sources/    readers for the driver tables, CSV/JDBC sources and the stand-in frames
  functions/  column-expression helpers (rounding, dates, distribution functions)
  operators/  reusable DataFrame -> DataFrame operators (clean, outliers, aggregates,
              windows, experiments, metrics, quality)
  plans/      whole analyses built from the operators; each is (spark, sf_dir) -> DataFrame
  streaming/  Structured Streaming form of the daily product metrics
"""

__version__ = "0.1.0"
