"""loomwave: a Spark-first engine for labelled multi-channel time series and the data around them."""
