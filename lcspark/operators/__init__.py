"""DataFrame -> DataFrame operators over observation and metadata tables.

Observation frames carry ``object_id, mjd, passband, flux, flux_err,
detected`` plus the caller's tie-break columns; every ordered operator
takes ``tie`` (a list of column names) so that the order inside an object
is total and results do not depend on partitioning.
"""
