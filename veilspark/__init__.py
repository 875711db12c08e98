"""veilspark: finding, replacing and auditing personal data with Spark DataFrames."""

__version__ = "0.1.0"
