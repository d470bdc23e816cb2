"""Analytics of irregularly sampled observations, as Spark jobs."""
