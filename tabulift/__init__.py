"""Profile, clean, encode, scale, chart, split, train and evaluate tables with Spark DataFrames."""
