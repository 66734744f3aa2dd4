"""orrery: multimodal retrieval, ranking and privacy analytics on Spark DataFrames."""
