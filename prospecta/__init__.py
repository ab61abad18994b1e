"""prospecta: company-registry lead jobs on Spark DataFrames."""

__version__ = "0.1.0"
