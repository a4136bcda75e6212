"""Trace analytics on PySpark: operators over recorded LLM-API traffic."""
