"""News-event and emotion-feed analytics on Spark DataFrames."""
