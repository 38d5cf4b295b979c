"""Whole jobs: guarded SQL, the call batch, the quality job and the image batch."""
