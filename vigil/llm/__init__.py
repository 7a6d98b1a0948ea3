"""Operators that prepare text for training language models.

Nothing else in the library imports this subpackage.  ``vigil.llm.queries`` registers one query per
operator, ``corpus_pipeline.py`` at the top of the repository chains five of them.
"""
