"""webloom: a Spark-native analytics engine for collections of already acquired web pages."""

__version__ = "0.1.0"
