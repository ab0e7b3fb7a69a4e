"""Training-data operators: thirteen document, page and vector operators for very large corpora.

Nothing outside this subpackage imports it.  Every module holds one operator with
a general interface; ``queries`` holds the thin registered queries on top.
"""
