"""Aligned sequence collections as relations: segmentation, block graphs and pattern location on Spark."""
