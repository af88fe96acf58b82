"""Spark-native analytics for collections of images, volumes and series."""

__version__ = "0.1.0"
