"""skein: code knowledge, retrieval and data-quality operators as Spark DataFrames."""
