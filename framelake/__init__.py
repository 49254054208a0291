"""Imaging analytics and table operators expressed with Spark DataFrames."""
