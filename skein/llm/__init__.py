"""Training-data operators: packing, sharding, chat formatting, deduplication, manifests, byte-level BPE, clustering,
quality and toxicity scoring, HTML extraction, rule learning and source mixing.

Nothing outside this subpackage imports it.
"""
