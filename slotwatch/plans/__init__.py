"""Pipelines that chain the operators into the full set of result tables."""
