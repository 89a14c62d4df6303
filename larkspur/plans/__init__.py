"""Drivers of whole computations: boosting, prediction, callbacks, cross-validation, adaptive stopping."""
