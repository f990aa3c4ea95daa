"""Event analytics on Spark: validated ingest, replayable views and the queries over them."""
