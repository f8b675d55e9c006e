"""PySpark library for book-and-place datasets: functions over DataFrames, no engine layer."""

__version__ = "0.1.0"
