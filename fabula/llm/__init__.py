"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to DataFrames; ``queries.py`` binds them to the
tables of a data folder.
"""
