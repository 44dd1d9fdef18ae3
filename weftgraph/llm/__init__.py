"""Operators of a training-data pipeline: decontamination, token counts, toxicity, quality,
mixing, chat formatting, HTML extraction and three kinds of deduplication.

Nothing else in the library imports this subpackage.
"""
