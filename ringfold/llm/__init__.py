"""Operations of a training-data pipeline over tables of documents and embeddings.

Nothing else in the library imports this subpackage. Each module holds one operator
with a general interface; ``queries`` holds the thin ``opN_<name>`` queries.
"""
