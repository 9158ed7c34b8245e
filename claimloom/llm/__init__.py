"""Operators for building training corpora: archives, filters, deduplication, counting, mixing, sharding.

Nothing else in the library imports this subpackage.  Operators take DataFrames and return
DataFrames; what they write goes to the folder that ``spark.checkpoint.dir`` names.
"""
