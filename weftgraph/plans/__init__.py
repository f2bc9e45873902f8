"""Registered queries, one registry a module."""

from weftgraph.plans import data_quality, features, layers, models, sampling, sources, streams, structure

REGISTRIES = [data_quality.R, structure.R, sampling.R, features.R, layers.R, models.R, sources.R, streams.R]
