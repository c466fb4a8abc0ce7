"""Byte-level codecs and converters: plain functions on bytes, and the column functions made of them."""
