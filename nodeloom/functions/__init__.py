"""Column functions over vector-valued columns."""
