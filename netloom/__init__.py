"""Analytics over crawled web corpora and the logs around them, written for Spark."""

__version__ = "0.1.0"
