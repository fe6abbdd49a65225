"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames, touches only the columns it is told about, and keeps its own
temporary columns under names that start with ``_gl_``.
"""
