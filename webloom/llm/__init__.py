"""Training-data operators: filtering, language ID, PII, dedup, decontamination, extraction and tokenising.

Nothing else in the library imports this subpackage; deleting it leaves the rest working.
"""
