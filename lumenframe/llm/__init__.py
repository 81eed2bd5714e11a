"""Training-data operators: language ID, HTML extraction, URL filters, toxicity,
fingerprints, BPE, near-dedup, sharding, quality resampling, decontamination,
chat formatting, token alignment, vector codes.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
