"""Rows that every operator has to stand."""

LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(30_000))
#: Null, empty, blank, very long, repeated, tied and odd texts; ids null and repeated.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (6, "same text"), (7, "same text"), (7, "same text"), (None, "same text"), (None, None), (8, "日本語 🙂 \x85\xa0"), (9, "Á \u0000 end"), (10, "<|endoftext|> x")]
