"""Operators for preparing training data: decontamination, tool-call linking, toxicity,
secret scans, URL filters, packing, near and exact de-duplication, WARC and line de-duplication.

Every operator takes DataFrames plus the names of its columns and returns DataFrames; the
registered queries in ``queries.py`` are thin calls of these operators.
"""
