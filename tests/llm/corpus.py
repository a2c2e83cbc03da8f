"""A small corpus with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 7))) for _ in range(120)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    base, hot = text(120), text(90)
    out = [(i, text(r.randint(1, 150)), r.choice(["en", "de"]), r.choice(["s1", "s2", "s3"]), 1) for i in range(n)]
    out += [(n + i, hot, "en", "s1", 1) for i in range(n // 2)]  # exact copies
    for i in range(n // 2):  # near copies: a word or two differ
        w = base.split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((2 * n + i, " ".join(w), "en", "s1", 1))
    k = 3 * n
    out += [(k, None, "en", "s1", None), (k + 1, "", None, None, 0), (k + 2, " \t\n ", "en", "s2", 4), (k + 3, "one", "en", "s2", 3), (k + 4, "One two", "en", "s2", 7), (k + 5, "one TWO", "fr", "s2", 7)]
    out += [(k + 6, text(9000), "en", "s3", 1), (k + 7, "x" * 50_000, "en", "s3", 1), (k + 8, "Ünï çødé Straße ΣΑΣ 中文 <|endoftext|> 🎉", "de", "s3", 1)]
    out += [out[0], out[1]]  # repeated rows
    return out
