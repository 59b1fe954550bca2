"""Movement analytics and table processing on Spark."""
