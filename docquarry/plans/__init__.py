"""Query definitions: criteria, declared datasets and the query registry."""
