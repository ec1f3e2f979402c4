"""Part of wheelgraph; see the README."""
