"""Column-level building blocks: grid arithmetic, curves, geometry, projection, scalars."""
