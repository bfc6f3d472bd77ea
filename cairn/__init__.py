"""Analytics over sparse block snapshots on Spark DataFrames."""
