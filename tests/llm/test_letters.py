"""Only letters make words of the language identification."""

from skuloom.llm.language_id import words_of


def test_signs_are_no_letters():
    assert words_of("² ½ Ⅷ 12 _ ٣") == []
    assert words_of("ab²c ½x Ünder_score 3rd") == ["ab", "c", "x", "ünder", "score", "rd"]
    assert words_of(None) == words_of("") == []
