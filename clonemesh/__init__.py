"""clonemesh: consensus clustering of receptor repertoires on Spark DataFrames."""

__version__ = "0.1.0"
