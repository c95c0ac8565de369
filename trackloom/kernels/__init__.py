"""NumPy kernels on pixel arrays, for use inside Arrow functions."""
