"""Operators for training-data pipelines over the text tables.

Nothing else in the library imports this subpackage; it can be deleted as a
whole.  Every operator takes and returns DataFrames, reads whole tables and whole
texts, and documents what nulls, empty tables, repeated rows and clashing column
names give.

Ids (doc_id, conv_id, turn) are whole numbers or strings of digits; other strings are an error when a query runs.
"""
