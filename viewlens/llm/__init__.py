"""Operators for preparing language-model training data.

Every module holds one operator with a general interface (data frames and
parameters in, data frame out); ``queries`` binds them to the tables of a data
folder.  Nothing outside this package imports it.
"""
