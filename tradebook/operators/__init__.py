"""DataFrame -> DataFrame steps: matching, deduplication, scoring, extraction, metrics."""
