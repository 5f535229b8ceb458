"""Sources and sinks: parquet/json/csv readers with explicit schemas, the
user document, snapshots, and the mapping of the driver's test tables onto
the demand-to-delivery data model."""
