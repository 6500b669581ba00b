"""cuelake: timed-text analytics and corpus operators on Spark DataFrames."""
