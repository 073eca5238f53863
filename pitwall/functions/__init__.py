"""Scalar column functions: ids, pedals, motion, wheels, setup values."""
