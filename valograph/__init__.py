"""valograph: a PySpark library for valuing the nodes of a citation-style graph."""
