"""textloom: corpus curation and analytics on Spark DataFrames."""
