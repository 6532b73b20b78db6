"""Claim-to-evidence analytics on Spark DataFrames."""
