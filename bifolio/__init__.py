"""Turns collections of documents into aligned tables of blocks, on Spark DataFrames."""
