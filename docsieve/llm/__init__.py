"""Operations of a training-data pipeline over documents, vectors and benchmarks.

Nothing outside this subpackage imports it.
"""
