"""Index, search, context and change-detection operators."""
