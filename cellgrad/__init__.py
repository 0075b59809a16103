"""cellgrad: feed-forward networks trained, run and scored as Spark queries.

Matrices are DataFrames, either as ``(i, j, v)`` cell rows (the relational
encoding) or as one row per example with ``ARRAY<DOUBLE>`` columns (the array
encoding).  Every step of training and evaluation is a join, aggregate, window
or array expression that Catalyst plans; Python only drives the step loop and,
in the array trainer, runs NumPy over Arrow batches inside Spark tasks.
"""

__version__ = "0.1.0"
