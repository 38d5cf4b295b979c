"""Operators of a training-data pipeline: near duplicates, licences, packing, quality, privacy, mixing."""
