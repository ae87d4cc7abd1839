"""Spark queries over public notices and notable people, and training-data operators in llm."""
