"""exprlake: symbolic-corpus analytics expressed as Spark DataFrame jobs."""
