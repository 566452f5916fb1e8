"""Analytics of accelerator and cluster performance data on Spark."""
