"""Small fixtures for the operator tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so", "ta") for b in ("ba", "den", "fil", "gor", "hus", "jat", "kel", "lum", "mon")]


def sentence(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + rng.choice(["", "", "s", "en"]) for _ in range(n)]


def edited(rng: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = "x" + str(rng.randrange(10**6))
    return out


def near_copies(seed: int = 3) -> list[tuple]:
    """Texts with exact copies, chains and stars of near copies, a common line, short, empty and null texts."""
    rng = random.Random(seed)
    line = " ".join(sentence(rng, 12))
    rows, i = [], 0

    def add(words, lang="en", source="src0"):
        nonlocal i
        text = words if words is None or isinstance(words, str) else " ".join(words)
        rows.append((i, text, lang, source, None if text is None else len(text)))
        i += 1
    for _ in range(12):  # a base with copies of growing distance, some of them edited again
        base = sentence(rng, rng.choice([8, 40, 150, 400]))
        add(base)
        for d in range(rng.randrange(1, 9)):
            copy = edited(rng, base, max(1, d * len(base) // 120))
            add(copy)
            if d % 2:
                add(edited(rng, copy, max(1, len(base) // 60)))
        add(" ".join(base).upper() + "\n")
    for _ in range(25):
        add(line + "\n" + " ".join(sentence(rng, rng.randrange(1, 120))))
    for text in (None, "", "   ", "one", "One", "one two three", "ONE two\tthree", "\x0b", "a b c d e", "a b c d e f", None):
        add(text)
    add(" ".join(["same"] * 400))
    add(" ".join(["same"] * 300))
    rng.shuffle(rows)
    return rows


def clashing(df):
    """The table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ("score", "kept", "tokens", "ids", "n", "node", "range", "ahead", "probability", "held_out", "secret_spans", "topic")
    return df.withColumns({c: F.lit(f"extra {c}") for c in names if c not in df.columns})
