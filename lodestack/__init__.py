"""lodestack: a PySpark engine for cataloguing files, searching them and processing large text collections."""
