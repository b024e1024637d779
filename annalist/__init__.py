"""annalist: provenance-bearing session-memory analytics on PySpark."""
