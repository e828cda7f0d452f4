"""Spark jobs over tables of beating-heart-cell movies."""
