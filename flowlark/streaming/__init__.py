"""Nothing yet: the surveyed system reads finished tables and has no streams, so none are made up."""
