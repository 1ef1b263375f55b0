"""Numeric kernels over one channel of samples: numpy only, no Spark."""
