"""Loomgraph: knowledge analytics over industrial documents on Spark."""
