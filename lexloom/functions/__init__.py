"""Column functions, fixed word lists and numeric kernels."""
