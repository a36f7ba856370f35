"""quern: an analytics engine built directly on PySpark."""
