"""Directory-data jobs on Spark: crawled pages in, clean company records out."""
