"""benang: analytics over threaded text records, built on Spark DataFrames."""

__version__ = "0.1.0"
