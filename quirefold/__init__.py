"""quirefold: document-corpus analytics on PySpark."""
