"""Quantification of point detections in large images against a region ontology, as Spark plans."""
