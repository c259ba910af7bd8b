"""Whole plans: the journey model, its reports, the extraction and the semantic layer."""
