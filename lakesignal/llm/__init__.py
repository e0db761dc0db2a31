"""Operators for building language-model training corpora.

Ten operators (fingerprints, substring removal, language identification,
nearest neighbours, near-duplicate linking, personal data, toxicity, packing,
suffix-array removal, byte-pair encoding), each a function from DataFrames to a
DataFrame.  Nothing outside this package imports it.
"""
