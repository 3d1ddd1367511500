"""Operators for training-data pipelines over very large text and vector tables.

Nothing outside this subpackage imports it.  Every operator takes DataFrames,
never collects rows of unbounded number to the driver and keeps intermediate
tables in the folder that ``spark.checkpoint.dir`` names.
"""
