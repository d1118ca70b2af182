"""corpusloom: a Spark-native analytics engine for stored web corpora."""

__version__ = "0.1.0"
