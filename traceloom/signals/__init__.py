"""Numpy kernels over one channel or one assay."""
