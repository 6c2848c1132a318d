"""Small awkward tables shared by the tests: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

import random

CLASHING = ("id", "n", "class", "keys", "digest", "row", "owner", "kept", "place", "n_tokens", "a", "b", "host", "v")

_WORDS = "the of and a to in is was for on that with as at by an be this from or The Of AND über ñandú été".split()


def words(rng: random.Random, n: int, rare: float = 0.4) -> list[str]:
    return [f"w{rng.randrange(5000)}{rng.choice(['', '', ',', '.', '!'])}" if rng.random() < rare else rng.choice(_WORDS) for _ in range(n)]


def texts(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = [(i, " ".join(words(rng, rng.choice([1, 3, 6, 7, 20, 60, 200])))) for i in range(n)]
    base = words(rng, 120)
    for k in range(12):  # near copies of one text
        near = list(base)
        for _ in range(k // 3):
            near[rng.randrange(len(near))] = f"x{k}"
        rows.append((100 + k, " ".join(near)))
    rows += [(200 + k, rows[5][1]) for k in range(9)]  # exact copies
    passage = " ".join(words(rng, 45))
    rows += [(300 + k, " ".join([*words(rng, 40), passage, *words(rng, 30)])) for k in range(8)]  # a shared passage
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "One"), (405, "same  space"), (406, "same\tspace"), (407, "z " * 3000),
             (408, "x" * 9000), (409, "cycle of seven words that goes round " * 12), (410, "   wide　spaces \x1c \x85"), (411, "<|endoftext|> a<|endoftext|>b <|startoftext|>")]
    rows += [(None, "no id one two three four five six"), (None, None), rows[7], rows[7]]  # null ids and a row three times
    return rows


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], "s", len(t or ""), *["?"] * len(CLASHING)) for k, (i, t) in enumerate(rows)], schema)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)
