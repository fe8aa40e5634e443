"""Stereo point-track analytics on Spark: matching, triangulation, deformation, signals, masks, candidates and media."""
