"""Dialogue, rollout and corpus analytics on Spark DataFrames."""
