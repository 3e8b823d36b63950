"""Data-quality, product-structure and master-data analytics on Spark DataFrames."""
