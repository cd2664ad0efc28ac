"""Planar polygons as structs of rings, and what the operators need of them."""
