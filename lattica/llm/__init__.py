"""Training-data operators.

Nothing outside this package imports it.  Each module holds one operator with
a general interface; :mod:`lattica.llm.queries` derives the registered digest
queries from them.
"""
