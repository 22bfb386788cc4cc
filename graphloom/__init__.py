"""graphloom: property-graph analytics on PySpark."""
