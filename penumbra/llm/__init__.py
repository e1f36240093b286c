"""Corpus operators for language-model training data.

Nothing outside this subpackage (but the guarded hook in ``__spark_entry__`` and
``corpus_pipeline``) imports it, so it can be removed as a whole.
"""
