"""Document retrieval, conversation analytics and corpus preparation on Spark DataFrames."""
