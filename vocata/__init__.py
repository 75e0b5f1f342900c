"""Spark-first analytics for resumes, job adverts and the skills that link them."""
