"""Analytics over data derived from documents and images, written for Spark."""
