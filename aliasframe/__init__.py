"""aliasframe: privacy-preserving ledger and text processing on Spark DataFrames."""
