"""Values: kinds, order, paths, words."""
