"""Operators for preparing training text (quality, licenses, chat, language,
decontamination, language-model scores, segmentation, similarity, repeats,
personal data)."""
