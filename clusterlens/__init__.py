"""Cluster-state analytics on Spark DataFrames.

Every operator is a plain function from DataFrames (or Columns) to DataFrames
(or Columns).  Nothing keeps a session, collects rows or depends on the wall
clock: the reference time is always an argument.
"""
