"""tideloom: temporal interaction analytics and training-data operators on Spark DataFrames."""
