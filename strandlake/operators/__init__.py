"""Operators: DataFrame in, DataFrame out; the planner picks the physical strategy."""
