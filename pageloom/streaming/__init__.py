"""Empty on purpose: the feature set has no event time, window or stream state.

Every operator of this package is a batch operator over tables.
"""
