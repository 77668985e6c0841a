"""Operators of a training-data pipeline: dedup, language, quality, LM scoring, chat, BPE, sharding, decontamination."""
