"""Reusable Spark SQL expressions.

Scalar helpers take and return expression text, to be used in ``F.expr``, ``selectExpr``
and ``filter``: a long formula is then one parsed expression, stays readable as SQL, and
runs inside generated code.
"""
