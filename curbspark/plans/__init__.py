"""Whole pipelines built from sources and operators."""
