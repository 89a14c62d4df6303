"""Relational operators of tree growing: binning, histograms, split search, routing, sampling, sketches."""
