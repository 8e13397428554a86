"""Tagged-fact analytics on Spark."""
