"""Sources and sinks."""

from lcspark.sources.io import *  # noqa: F401,F403
