"""Public-record analytics on Spark: profile, gate, resolve and review open-data snapshots."""
