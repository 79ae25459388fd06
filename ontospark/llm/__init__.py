"""Training-data operators: WARC bundles, telephony audio, class n-gram scoring,
quality classification, chat formatting, packing, near-duplicate search, line
deduplication, uniform sharding and benchmark decontamination.

Nothing else in the library imports this subpackage.
"""
