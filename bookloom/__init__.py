"""Order-book replay, microstructure analytics and corpus preparation on Spark."""
