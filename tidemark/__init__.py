"""tidemark: Spark-first processing of card-transaction decisions, labels, features and texts."""
