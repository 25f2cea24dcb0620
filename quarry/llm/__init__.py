"""Training-data operators: thirteen jobs over documents, pages, vectors and conversations and the queries that apply them.

Nothing outside this subpackage imports it.
"""
