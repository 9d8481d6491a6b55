"""Sources and sinks: raw log scans, the driver-table fixture mapping and
snapshot / cache tables."""
