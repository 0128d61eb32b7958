"""Spark-native lattice thermodynamics and configuration analytics."""
