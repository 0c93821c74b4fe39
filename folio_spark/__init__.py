"""folio_spark: batch analytics over versioned, article-structured documents, on Spark DataFrames."""
