"""functions of the engine; see the README."""
