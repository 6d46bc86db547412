"""The comparison key of one string, stated for the tests."""

import unicodedata


def plain_key(text):
    plain = [c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)]
    return " ".join("".join(plain).split()).casefold()
