"""Analyses: network inference, storage, decomposition, comparison, subgraphs, history dependence."""
