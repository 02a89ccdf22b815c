"""Spark-first analytics over rasters, masks, points, detections, model responses and text corpora."""
