"""Evidence-anchored notes at corpus scale, as Spark DataFrame jobs."""
