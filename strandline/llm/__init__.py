"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to DataFrames; ``queries`` binds the thin registered
queries and ``oracles`` the SQL twins of those that SQL can express.
"""
