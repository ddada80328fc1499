"""Surface-kinetics analytics on Spark DataFrames."""
