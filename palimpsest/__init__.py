"""Versioned key/value snapshots on Spark: stacks of step ranges, newest wins.

NULL means absent and ``X''`` means empty, everywhere.  Order is data
(``ordinal``, ``rank``, ``pos``), never the position of a row in a DataFrame.
"""

__version__ = "0.1.0"
