"""Statistical functions as columns."""
