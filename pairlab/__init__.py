"""pairlab: Spark jobs for curating, scanning and evaluating paired code data."""
