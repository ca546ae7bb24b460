"""Training-data operators: search, packing, scanning, scoring, deduplication and mixing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames,
selects the columns it needs by name (so extra columns never clash) and keeps
its result a distributed DataFrame.
"""
