"""Pure functions on one page: reading, layout, alignment, matching and artwork.  Spark applies them to batches of pages."""
