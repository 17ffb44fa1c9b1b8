"""Set-oriented trade-flow analytics on PySpark."""
