"""Training-data operators: one module for each, plus the queries over them.

Nothing else in the library imports this subpackage.
"""
