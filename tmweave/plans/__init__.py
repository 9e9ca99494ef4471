"""Composite pipelines (C1-C7) and the registered queries over the sample tables."""
