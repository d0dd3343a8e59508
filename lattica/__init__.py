"""Relational, graph and Datalog-style analytics on Spark DataFrames."""
