"""Reading and writing datasets, response logs, metric stores and experiment tables."""
