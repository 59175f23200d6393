"""Voxel tables, label tables and iterative DataFrame algorithms on Spark."""
