"""Evidence analytics on Spark: timed text in, evidence-linked tables and cited answers out."""
