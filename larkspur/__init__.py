"""larkspur: secret scanning and analytics as Spark jobs."""
