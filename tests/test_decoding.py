"""Decodings: the measure of odd characters against its definition, and no more charsets tried than needed."""

import random
import unicodedata

from evidencelake.functions import cleanup


def test_oddness_by_definition():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(300), rng.randrange(0xE000, 0x110000), rng.randrange(0xFF50, 0xFFB0)))) for _ in range(10))
        odd = sum(4 for c in text if unicodedata.category(c) in ("Co", "Cn", "Cc") and c not in "\r\n\t" or "｡" <= c <= "ﾟ")
        assert cleanup.oddness(text) == (6 * len(cleanup.GARBLED.findall(text)) + 12 * text.count("�") + odd) / len(text)


def test_first_faultless_decoding_ends_the_search(monkeypatch):
    seen = []
    monkeypatch.setattr(cleanup, "repair", lambda text: seen.append(text) or text)
    assert cleanup.decode("naïve café".encode(), "text/html; charset=utf-8") == "naïve café" and len(seen) == 1
    assert cleanup.decode(b"caf\xe9", "text/html; charset=utf-8") == "café" and len(seen) > 1
