"""spectrail: multivariate spectral analytics as Spark DataFrame programs."""
