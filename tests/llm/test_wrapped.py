"""Sentences that run over line ends."""

from __future__ import annotations

from tidemark.llm.language import sentences, words


def test_short_lines_of_one_sentence_are_put_together():
    text = "The old man walked\nslowly down to the\nharbour before dawn."
    assert [s for _, _, s in sentences(text)] == ["The old man walked slowly down to the harbour before dawn."]
    assert words(sentences(text)[0][2]) == 11


def test_a_wrapped_part_of_a_mixed_text_is_one_sentence():
    text = "We read this aloud in class today.\nDer alte Mann ging\nlangsam hinunter zum\nalten Hafen.\nThen we all went home."
    assert [s for _, _, s in sentences(text)] == ["We read this aloud in class today.", "Der alte Mann ging langsam hinunter zum alten Hafen.", "Then we all went home."]


def test_a_capital_still_starts_a_sentence():
    assert [s for _, _, s in sentences("A heading\nThe text goes on")] == ["A heading", "The text goes on"]
