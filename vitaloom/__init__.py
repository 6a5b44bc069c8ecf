"""Health-record analytics on Spark: relational reads, trends, retrieval, text linking, safety rules and stateful operators."""
