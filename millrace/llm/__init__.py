"""Training-data operators: scanning, deduplication, filtering, extraction,
tokenization, formatting and mixing. Nothing else in the library imports this."""
