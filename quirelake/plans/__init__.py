"""plans of the document engine."""
