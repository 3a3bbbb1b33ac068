"""Measuring and building labelled text datasets with PySpark DataFrames."""
