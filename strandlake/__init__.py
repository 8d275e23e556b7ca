"""strandlake: sequencing-style analytics as Spark DataFrame operators."""
