"""Citation extraction and resolution over large document collections, on Spark."""
