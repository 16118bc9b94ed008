"""Analytics over governed text, code, vectors, graphs and events on Spark."""
