"""gridscope: automatic table analysis on Spark DataFrames.

Every operator takes a DataFrame (plus column names / options) and returns a
DataFrame.  The scan, shuffle and aggregate work runs in Spark; only per-column
scalars or k x k matrices (k = number of columns) ever reach the driver.
"""

__version__ = "0.1.0"
