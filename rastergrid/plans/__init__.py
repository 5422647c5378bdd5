"""End-to-end pipelines, the derived test inputs, the query registry and its oracle SQL."""
