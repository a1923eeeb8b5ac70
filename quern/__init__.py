"""quern: an analytics engine for linked data, written for Spark."""

__version__ = "0.1.0"
