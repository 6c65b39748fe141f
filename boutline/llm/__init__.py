"""Training-data operators: ten stages of a text pipeline, each on whole tables."""
