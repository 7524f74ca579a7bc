"""Fixed dimensions, composed plans and the registered query set."""
