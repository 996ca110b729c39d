"""treequill: XPath 2.0 queries and XML Schema validation as Spark plans."""

__version__ = "0.1.0"
