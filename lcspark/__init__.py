"""lcspark: light-curve feature vectors as Spark DataFrame jobs.

Long observations (one row per object, time and channel) plus a per-object
metadata table become training tables: pivots, per-object arrays, padded
sequences, interval and wavelength features, augmentation, splits, ML
vectors and class-weighted evaluation.  Every operator is a function
``DataFrame -> DataFrame`` built from Spark's built-in functions.
"""

__version__ = "0.1.0"
