"""Training-data operators (deduplication, formatting, tokenising, packing, sharding).

Self-contained: nothing else in the package imports this folder. General
helpers of the package (session, tables) may be imported from here.
"""
