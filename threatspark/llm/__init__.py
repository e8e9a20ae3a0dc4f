"""Operators of a training-data pipeline; see README, section "Training-data operators".

Nothing else in the package imports this subpackage.
"""
