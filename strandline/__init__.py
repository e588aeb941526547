"""strandline: temporal property-graph analytics on Spark."""
