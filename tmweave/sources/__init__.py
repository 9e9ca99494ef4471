"""Readers (S1-S6): upload events, object manifests, TMX files, documents, TM."""
