"""Operators put together: the layer build, chart views and guarded answers."""
