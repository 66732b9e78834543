"""Rasters as pixel tables, vectors as tables of features."""
