"""Training-data operators: filtering, near-duplicates, tokens, sharding and scoring.

Nothing else in the library imports this subpackage.
"""
