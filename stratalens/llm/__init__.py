"""Operators for building training corpora at scale, one module per operator.

Nothing outside this package imports it.  Each module has a general operator
and a thin ``query`` that applies it to the driver's tables.
"""
