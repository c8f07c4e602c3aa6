"""A plain-language auditor on Spark DataFrames."""
