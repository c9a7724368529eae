"""granary: corpus preparation and auditing on Spark DataFrames."""
