"""Where graphs come from: readers of edge and feature files, and graphs derived from tables."""
