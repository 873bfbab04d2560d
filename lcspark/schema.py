"""Schemas and fixed values.

The fixed values below must equal the reference's for equal results.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the reference's numbers for equal results)
# ---------------------------------------------------------------------------
# Class codes, in index order 0..14.
CLASS_CODES = [6, 15, 16, 42, 52, 53, 62, 64, 65, 67, 88, 90, 92, 95, 99]
# Class weights: 2 for classes 15 and 64, 1 for every other class.
CLASS_WEIGHTS = {6: 1, 15: 2, 16: 1, 42: 1, 52: 1, 53: 1, 62: 1, 64: 2,
                 65: 1, 67: 1, 88: 1, 90: 1, 92: 1, 95: 1, 99: 1}
# Passband wavelengths in nm for passbands 0..5 (u g r i z y).
PASSBAND_NM = [357, 477, 621, 754, 871, 1004]
# Padded sequence length, copies per object, object limit.
SEQUENCE_LEN = 256
AUGMENT_COUNT = 25
OBJECT_LIMIT = 1_000_000
# Share of observations dropped per copy in the baseline augmentation.
DROP_RATE = 0.3
# Redshift clamp of the baseline augmentation.
Z_MIN, Z_MAX = 0.0, 5.0
# Probability clip of the log losses.
CLIP_EPS = 1e-15
# Index given to unknown classes, and the class count.
UNKNOWN_CLASS_INDEX = 14
N_CLASSES = 15
# Channel order of the 8-channel history used by the baseline program.
HIST_CHANNELS = ["mjd", "flux", "flux_err", "detected", "fwd_int", "bwd_int",
                 "source_wavelength", "received_wavelength"]
# Channels the baseline network input zeroes (absolute time, detected,
# received wavelength).
ZEROED_CHANNELS = [0, 3, 7]
# ---------------------------------------------------------------------------

OBS_COLUMNS = ["object_id", "mjd", "passband", "flux", "flux_err", "detected"]

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("object_id", T.LongType(), False),
    T.StructField("mjd", T.DoubleType(), True),
    T.StructField("passband", T.IntegerType(), True),
    T.StructField("flux", T.DoubleType(), True),
    T.StructField("flux_err", T.DoubleType(), True),
    T.StructField("detected", T.IntegerType(), True),
])

META_COLUMNS = ["object_id", "ra", "decl", "gal_l", "gal_b", "ddf",
                "hostgal_specz", "hostgal_photoz", "hostgal_photoz_err",
                "distmod", "mwebv", "target"]

METADATA_SCHEMA = T.StructType([
    T.StructField("object_id", T.LongType(), False),
    T.StructField("ra", T.DoubleType(), True),
    T.StructField("decl", T.DoubleType(), True),
    T.StructField("gal_l", T.DoubleType(), True),
    T.StructField("gal_b", T.DoubleType(), True),
    T.StructField("ddf", T.IntegerType(), True),
    T.StructField("hostgal_specz", T.DoubleType(), True),
    T.StructField("hostgal_photoz", T.DoubleType(), True),
    T.StructField("hostgal_photoz_err", T.DoubleType(), True),
    T.StructField("distmod", T.DoubleType(), True),
    T.StructField("mwebv", T.DoubleType(), True),
    T.StructField("target", T.IntegerType(), True),
])

TEST_METADATA_SCHEMA = T.StructType(METADATA_SCHEMA.fields[:-1])

RUN_METRICS_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType(), True) for n in (
        # what ran
        "run_id", "program", "model", "data_source", "spark_master",
        # the settings it ran with
        "app_id", "executor_memory", "executor_cores", "driver_memory", "driver_cores", "default_parallelism",
        "deploy_mode", "executor_instances", "app_name")]
    + [T.StructField(f"{stage}_{kind}", T.DoubleType(), True)
       for stage in ("dataframe", "samples", "augment", "train_vectors",
                     "validation_vectors", "build_model", "train_model",
                     "predict", "total")
       for kind in ("elapsed", "cpu")]
)
