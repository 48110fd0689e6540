"""kinetrack: trajectory and state-sequence analytics on PySpark."""
