"""Plain-Python models of the row rules, for comparison with the Spark forms."""

import random
import re

PIECES = re.compile(r"#[A-Za-z0-9_]+|@[A-Za-z0-9_]+|\w+://\S+|\w+|\s+|.", re.S)


def clean(text):
    out = []
    for piece in PIECES.findall(text):
        if len(piece) > 1 and piece[0] == "#":
            out.append(re.sub(r"([a-z])(?=[A-Z])", r"\1 ", piece[1:]) + ",")
        elif (len(piece) > 1 and piece[0] == "@") or "://" in piece:
            out.append(" ")
        elif piece == "," or re.fullmatch(r"\w+|\s+", piece):
            out.append(piece)
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def partial(gold, pred):
    free = list(range(len(gold)))
    pairs, false = [], []
    for item in pred:
        hit = next((j for j in free if item in gold[j] or gold[j] in item), None)
        if hit is None:
            false.append(item)
        else:
            free.remove(hit)
            pairs.append((gold[hit], item))
    return pairs, false, [gold[j] for j in free]


def spans(items):
    kept = []
    for start, size in sorted(items, key=lambda s: (-s[1], s[0])):
        if all(start + size <= a or a + b <= start for a, b in kept):
            kept.append((start, size))
    return sorted(kept)


def fold(values):
    """Whole cents, halves to even."""
    level = values[0]
    for v in values[1:]:
        level = round((level + v) / 2)
    return level


def texts(seed, n):
    rng = random.Random(seed)
    parts = [
        "#RockIsland", "#aB#cD", "#Rocké", "@user_1", "@http://x.y/#Foo", "http://x/#FooBar", "é’s", "ünï", "a_b",
        "##", "#", "quake‑test", "#flood,now", "(#sismo)", "#iPhoneXS", "café", "!", ",", "\n", "  ", "O'Fallon",
        "New", "York", "@é://z", "#aé://q", "日本語", "x://", "ß", "Ab9",
    ]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]
