"""Address search and geocoding over DataFrames, and operators for training-data pipelines."""
