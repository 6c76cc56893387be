"""Semantic graphs as DataFrames: templates make triples, shapes validate and query them, rules extend them.

A graph is a DataFrame with string columns s, p, o that hold terms in N-Triples notation, without
repeated rows.  Templates, shapes and parsers are small driver-side plans; instance data
is only ever touched by DataFrame operations.
"""
