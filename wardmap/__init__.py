"""Facility-registry analytics written for Spark DataFrames."""
