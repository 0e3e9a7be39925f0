"""DataFrame-in, DataFrame-out operators. All are lazy and take their clock as ``as_of``."""
