"""Price-intelligence analytics and corpus preparation on Spark DataFrames."""
