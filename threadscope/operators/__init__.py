"""DataFrame -> DataFrame operators (filters, joins, aggregates, windows, trees, batch inference)."""
