"""siltworks: analytics over bytes, compressed streams and measurements, as plain Spark DataFrames."""
