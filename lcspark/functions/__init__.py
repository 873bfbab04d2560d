"""Column-level functions: scalar expressions, array functions and keyed
random numbers.  All are built-in Spark expressions (no Python UDF)."""

from lcspark.functions.arrays import *  # noqa: F401,F403
from lcspark.functions.expr import *  # noqa: F401,F403
from lcspark.functions.rng import *  # noqa: F401,F403
