"""Curb-parking analytics on PySpark.

Everything here is a function from DataFrames and Columns to DataFrames and
Columns.  Nothing collects rows to the driver and nothing runs a Python row
function; the caller decides when to write or collect.
"""

__version__ = "0.1.0"
