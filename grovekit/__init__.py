"""Analytics over collections of trees, expressed as Spark DataFrames."""
