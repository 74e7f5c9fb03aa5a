"""Collections as tables, and the finders over them."""
