"""DataFrame-to-DataFrame helpers for the places where plain PySpark needs a named rule."""
