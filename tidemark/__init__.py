"""tidemark: table cleaning, validation, profiling and analytics on Spark DataFrames."""
