from __future__ import annotations

import random
import unicodedata

import regex

_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = regex.compile(rf"(?V1)[{_UNSPACED}]|[\p{{L}}\p{{N}}--[{_UNSPACED}]]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if unicodedata.category(c)[0] != "M")
    return WORD.findall(bare.lower())


def prose(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = "".join(r.choice("abdehilmnorst") for _ in range(r.randint(2, 7)))
        out.append((w.capitalize() if i % 9 == 0 else w) + (". " if i % 9 == 8 else " "))
    return "".join(out).strip() + "."


def edited(r: random.Random, text: str, n: int) -> str:
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = "".join(r.choice("abdehilmnorst") for _ in range(4))
    return " ".join(w)


def grams(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def linked(ids, pairs) -> dict[int, int]:
    """id to least id of its component, for ids in some pair."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    some = {x for p in pairs for x in p}
    return {x: root(x) for x in some}


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, wordless and very long texts, repeated rows."""
    r = random.Random(3)
    long = prose(r, 60_000)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "?!.", None, "b", 3), (None, prose(r, 40), "en", None, None), (None, None, None, None, None),
        (5, long, "en", "a", len(long)), (6, "one two", "en", "b", 7), (7, prose(r, 50), "en", "a", 1), (7, None, "en", "a", 1), (8, "İstanbul Ünïcode ẞtraße Ωmega naïve café déjà vu", "de", "b", 1),
    ] + [(9, "same row again and again here", "en", "a", 29)] * 3
