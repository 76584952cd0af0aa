"""Security-log analytics on Spark DataFrames.

Raw lines are detected and parsed into typed columns, matched against a table of
detection rules compiled to Spark expressions, correlated over time, scored per
host, and reported on, as batch or streaming DataFrames.
"""
