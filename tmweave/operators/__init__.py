"""DataFrame -> DataFrame operators of the translation pipeline."""
