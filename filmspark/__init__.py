"""Spark jobs for the data work behind film-archive remastering, and (in ``filmspark.llm``) for training-data pipelines."""
