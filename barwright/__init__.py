"""Market-data analytics on Spark: DataFrame in, DataFrame out."""
