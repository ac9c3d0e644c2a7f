"""Place resolution, retrieval ranking, evidence and search-quality jobs on Spark."""
