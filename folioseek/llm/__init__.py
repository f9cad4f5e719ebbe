"""Training-data operators on Spark.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
