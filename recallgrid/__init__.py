"""Analytics over context records on Spark: search, ranking, graph, lifecycle,
text extraction and streaming triggers, as DataFrame plans over Parquet."""
