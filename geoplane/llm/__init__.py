"""Training-data operators (language ID, near-duplicates, decontamination, tokenisation, ...).

Nothing else in the library imports this subpackage; ``corpus_pipeline.py`` at
the repository top chains five of the operators.
"""
