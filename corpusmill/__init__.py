"""Corpus analytics on PySpark: code and text corpora as DataFrames."""
