"""millrace: data preparation, profiling and text-privacy operators for Spark DataFrames."""

__version__ = "0.1.0"
