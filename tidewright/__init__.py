"""Time-series and training-data analytics expressed as Spark DataFrame plans."""
