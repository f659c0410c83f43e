"""Place catalogues, travel tables and itineraries as Spark DataFrame jobs."""
