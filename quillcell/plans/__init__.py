"""Table adapters, the pipeline and the query catalogue."""
