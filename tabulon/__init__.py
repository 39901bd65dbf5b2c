"""Table analysis, dataset loading and training-data preparation on Spark."""
