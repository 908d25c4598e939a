"""Site-crawl analytics on Spark: links, crawl frontiers, page delivery and crawl logs as DataFrames."""

__version__ = "0.1.0"
