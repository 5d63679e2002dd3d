"""Training-data operators: filtering, matching, packing, formatting and sharding of text corpora.

Nothing outside this subpackage imports it.
"""
