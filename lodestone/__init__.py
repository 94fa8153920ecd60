"""Analytics over a library of saved pages and notes, written for Spark."""
