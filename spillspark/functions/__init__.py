"""Column builders: geodesy, projections, geometry, text and rounding rules."""
