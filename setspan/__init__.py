"""Set-enrichment analytics as Spark jobs: many contrasts against many set collections in one plan."""
