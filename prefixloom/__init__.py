"""Lexicons as prefix trees, in DataFrame terms: a trie is a relation keyed by prefix, insertion an aggregation, a walk an equi-join."""
