"""Column-level functions (built-in Spark expressions; two Arrow UDFs in `names`)."""
