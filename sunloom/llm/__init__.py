"""Training-data operators on Spark DataFrames: deduplicate, pack, mix, format, score, decode, scan and filter."""
