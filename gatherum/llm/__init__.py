"""Training-data operators: quality, archives, sharding, decontamination, privacy, licences, copies, secrets, language, tokens.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
