"""Sluice: preparation, sampling and evaluation of labelled event records on Spark DataFrames."""
