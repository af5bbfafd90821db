"""Operators: DataFrame -> DataFrame functions, by area."""
