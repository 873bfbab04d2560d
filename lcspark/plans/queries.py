"""Registered queries.  Importing this module fills the registry."""

from lcspark.plans import q_basic  # noqa: F401
from lcspark.plans import q_vectors  # noqa: F401
from lcspark.plans import q_more  # noqa: F401
