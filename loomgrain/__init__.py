"""loomgrain: DataFrame operators for software-change analytics on Spark."""
