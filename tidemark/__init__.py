"""Change-data, test-data and bulk-validation operators on Spark DataFrames."""
