"""Market-basket relationships, recommendation, pricing and catalogue search as Spark jobs."""
