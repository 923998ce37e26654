"""Composed plans (discovery, sampling/labelling/report, preprocessing) and the query registry."""
