"""DataFrame-level operators on scenes, tiles and features."""
