"""Compilers from document-query dictionaries to Spark columns and plans."""
