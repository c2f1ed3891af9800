"""Spark-native food-catalogue and intake analytics.

Every function here takes and returns DataFrames (or Columns) and only declares a
plan; nothing collects rows to the driver unless its docstring says so and states
the bound.
"""
