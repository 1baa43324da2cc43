"""DataFrame-to-DataFrame operators for replicate spectral data, built on Spark SQL."""
