"""Credit-risk data and model-monitoring engine on Spark DataFrames."""
