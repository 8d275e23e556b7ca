"""Training-data operators: one module an operator, ``queries`` with the registered queries.

Nothing outside this package imports it.
"""
