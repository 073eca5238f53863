"""Dataset-level plans: preprocess, validate, merge, summarise, export."""
