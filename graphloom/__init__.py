"""Graph retrieval, record linkage, network analytics and monitoring on Spark DataFrames."""
