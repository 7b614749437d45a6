"""Training-data operators: filtering, deduplication, scanning, mixing, sharding and tokenising corpora.

Nothing else in the library imports this subpackage.
"""
