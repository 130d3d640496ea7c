"""Conversation and order-fact analytics on Spark DataFrames."""
