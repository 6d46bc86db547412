"""What the word table holds of a word equals the rules, and plain lower-case words take no rule."""

from noticeflow.llm.decontaminate import Words

PLAIN = ["table", "ähre", "straße", "ñandú", "ŉa"]
OTHERS = ["three", "km", "in", "Table", "TABLE", "12", "12km", "a.", "word,", "end.", "(quoted", "ǅem", "İx", "x2", "日本", "-", "iv)", "ª"]


def test_facts_of_all_kinds_of_words(monkeypatch):
    words, rules, asked = Words(), Words._facts, []
    monkeypatch.setattr(Words, "_facts", lambda self, word: asked.append(word) or rules(self, word))
    plain, kind, flags = words.of([PLAIN + OTHERS, PLAIN])
    got = list(zip(plain.tolist(), kind.tolist(), flags.tolist()))
    assert got == [rules(words, w) for w in PLAIN + OTHERS + PLAIN]
    assert not set(asked) & set(PLAIN)
