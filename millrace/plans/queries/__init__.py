"""Queries over the driver's tables, with their SQL, one module for each group of operators."""
