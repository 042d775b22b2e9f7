"""Fixed values that have to equal the published ones."""

# Special tokens in id order.
SPECIAL_TOKENS = ("[g_start]", "[g_end]", "[unknown]", "[pad]")
UNKNOWN_ID = 2

# Seed openings appended to every opening list.
SEED_OPENINGS = (
    ("Open Game", "1.e4 e5"),
    ("Sicilian", "1.e4 c5"),
    ("French", "1.e4 e6"),
    ("Caro-Kann", "1.e4 c6"),
    ("Scandinavian", "1.e4 d5"),
    ("Pirc/Modern", "1.e4 d6"),
    ("Alekhine", "1.e4 Nf6"),
    ("Nimzowitsch", "1.e4 Nc6"),
    ("Queen's Pawn", "1.d4 d5"),
    ("Indian Systems", "1.d4 Nf6"),
    ("Dutch", "1.d4 f5"),
    ("English", "1.c4"),
    ("Reti", "1.Nf3"),
    ("e4 e5 Nf3", "1.e4 e5 2.Nf3"),
    ("e4 e5 Nf3 Nc6", "1.e4 e5 2.Nf3 Nc6"),
    ("e4 e5 Nf3 Nc6 Bc4", "1.e4 e5 2.Nf3 Nc6 3.Bc4"),
    ("e4 e5 Nf3 Nc6 Bb5", "1.e4 e5 2.Nf3 Nc6 3.Bb5"),
    ("d4 d5 c4", "1.d4 d5 2.c4"),
    ("d4 d5 Nf3", "1.d4 d5 2.Nf3"),
    ("d4 Nf6 c4 g6", "1.d4 Nf6 2.c4 g6"),
    ("d4 Nf6 c4 e6 Nc3 Bb4", "1.d4 Nf6 2.c4 e6 3.Nc3 Bb4"),
    ("d4 Nf6 c4 c5", "1.d4 Nf6 2.c4 c5"),
)
