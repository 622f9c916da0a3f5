"""Training-data operators: ten corpus-scale filters, joins and writers, each in its own module."""
