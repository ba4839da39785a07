"""corpusloom: literature association mining and corpus processing on Spark DataFrames."""
