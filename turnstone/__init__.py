"""Turnstone: conversation-log inspection and analytics, built on Spark DataFrames."""
