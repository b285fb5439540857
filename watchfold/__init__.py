"""User behaviour analytics on Spark: log ingestion, user-day features, sequences, graphs, scoring, alerts."""
