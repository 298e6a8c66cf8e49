"""Training-data operators (numbered 1 to 10) over documents and embeddings.

Every module holds one operator with a general interface; ``queries`` derives the
contract columns from it.  Nothing outside this subpackage imports it.
"""
