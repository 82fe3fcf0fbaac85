"""Semi-structured sports pages, season statistics and dashboards on Spark DataFrames."""
