"""Operators for building training corpora, each a Spark job over documents or pages.

Nothing outside this subpackage imports it. `queries` holds the registered
queries, one for each operator, and the SQL that checks them where SQL can.
"""
