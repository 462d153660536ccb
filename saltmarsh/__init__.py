"""Time-series analytics on Spark: long tables of (series, d, v) and plans over them."""
