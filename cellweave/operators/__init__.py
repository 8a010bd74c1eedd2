"""Operators over networks: structure, state spaces, local arguments, chains, and kernels for one network at a time."""
