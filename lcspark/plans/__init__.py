"""Query plans: bindings of the driver's tables to the observation and
metadata schemas, the registered queries, and their SQL oracles."""
