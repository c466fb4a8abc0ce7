"""Vintage storage at scale: containers, catalogues, codecs and converters as Spark DataFrames."""
