"""Streams of placements: stateless operators on each query, running mass by edge."""
