"""Vector types, element-wise functions, distances and aggregates as Columns."""
