"""Bar and event research on Spark: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
