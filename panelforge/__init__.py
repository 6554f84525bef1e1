"""Price-panel and ledger analytics as PySpark DataFrame functions."""
