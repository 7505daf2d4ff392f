"""Operators for training-data pipelines over document tables.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``registry`` holds the thin queries over the driver
tables and their SQL.
"""
