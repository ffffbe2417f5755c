"""Texts that are empty, missing, white, long or unusual."""

ODD = ["", None, " ", "\n\n", "a", "A  b\tc", "é ñ ß", "日本 語", "x" * 3000, "w " * 40000, "\x00 \x0b \x1c y", "end."]
