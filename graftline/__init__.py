"""JSON document analytics on Spark: flattening, paths, schemas, filters, replacement."""
