"""Scalar functions as Spark columns, and the few that need Python."""
