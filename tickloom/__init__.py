"""Market analytics as Spark DataFrame jobs: bars, features, chains, models, streams."""
