"""rollbook: analytics over ledger-like tables, written as Spark DataFrame plans."""
