"""Table -> result-table operators."""
