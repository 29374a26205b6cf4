"""Operators for building training corpora: secrets, near and exact duplicates,
quality, token statistics, decontamination, HTML text, language, chat formatting
and SentencePiece encoding.

Nothing else in the library imports this package. ``queries`` holds the driver
queries; every operator module keeps its own general interface.
"""
