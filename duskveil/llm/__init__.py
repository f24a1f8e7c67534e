"""Operations of a training-data pipeline over documents, conversations, pages and vectors.

Nothing outside this subpackage imports it.
"""
