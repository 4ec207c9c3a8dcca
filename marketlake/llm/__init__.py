"""Operators for preparing training data: sharding, language, mixing, de-duplication, search, privacy, tokens, chat, decontamination."""
