"""Personal data by a linear-chain conditional random field over word shapes.

A chain is a line of text; its items are the runs of characters other than white space. Each item has binary features
of its shape, and those of both neighbours. The weights are trained by gradient ascent with forward and backward sums
from a small labelled table (LABELLED builds one from templates; any rows of the same form will do), and lines are
decoded by Viterbi in numpy batches of padded lines.

Only lines with a digit or an at sign are decoded. That changes nothing: decode_all() is true unless, by the trained
weights, no path of items without either can beat the one of all O, and then every line is decoded.

Defined cases: null and empty texts have no finding. Null ids are allowed. Repeated rows give repeated findings. An
empty table gives an empty result. Texts are read whole, at any length. Other columns are not read by find() and pass
through redact().
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import lean

TAGS = ["O", "EMAIL", "B-PHONE", "I-PHONE", "B-CARD", "I-CARD", "IP", "SECRET"]
_LINE = re.compile(r"[^\n]+")
_SOME = re.compile(r"[0-9@]")
_ITEM = re.compile(r"\S+")
_KEYS = {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "api_key", "auth", "bearer"}
_CALLS = {"tel", "phone", "call", "fax", "mobile"}
_CORE = re.compile(r"^[^0-9A-Za-z+(]*(.*?)[^0-9A-Za-z)]*$", re.S)
_SHAPES: list[tuple[str, re.Pattern]] = [
    ("mail", re.compile(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}")),
    ("quad", re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")),
    ("octets", re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")),
    ("country", re.compile(r"\+[0-9]{1,3}")),
    ("area", re.compile(r"\([0-9]{2,4}\)")),
    ("local", re.compile(r"[0-9]{3,4}[-.][0-9]{4}")),
    ("dashed", re.compile(r"\+?[0-9]{1,3}([-.][0-9]{2,4}){2,3}")),
    ("long_call", re.compile(r"\+[0-9]{9,14}")),
    ("card", re.compile(r"[0-9]{13,19}")),
    ("four", re.compile(r"[0-9]{4}")),
    ("fours", re.compile(r"[0-9]{4}(-[0-9]{4}){3}")),
    ("hex", re.compile(r"(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{20,}")),
    ("mixed", re.compile(r"(?=\S*[0-9])(?=\S*[A-Za-z])[A-Za-z0-9_+/=\-]{20,}")),
    ("prefixed", re.compile(r"(?:sk|pk|ghp|xox[abp]|AKIA)[A-Za-z0-9_\-]{10,}")),
    ("number", re.compile(r"[0-9]+([.,][0-9]+)?")),
    ("dotted", re.compile(r"[0-9]+(\.[0-9]+){1,2}")),
    ("date", re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")),
    ("time", re.compile(r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?")),
]
NAMES = ["bias", *[n for n, _ in _SHAPES], "digit", "at", "letters", "assign", "key", "call", "quoted", "no_digit", "edge"]
_AT = {n: i for i, n in enumerate(NAMES)}
D, L = len(NAMES), len(TAGS)


def shape(item: str) -> tuple[int, ...]:
    """The features that an item has; edge is that of no neighbour."""
    found = ["bias"]
    core = _CORE.match(item).group(1)
    if any("0" <= c <= "9" for c in item) or "@" in item:
        value = core.split("=", 1)[1].strip("\"'") if "=" in core and core.split("=", 1)[0].lower() in _KEYS else core
        found += [n for n, p in _SHAPES if p.fullmatch(value)]
        found += ["digit"] * any("0" <= c <= "9" for c in item) + ["at"] * ("@" in item) + ["key"] * (value is not core)
        found += ["letters"] * any(c.isalpha() for c in core) + ["quoted"] * (item[0] in "\"'")
    else:
        word = core.rstrip(":").lower()
        found += ["no_digit"] + ["assign"] * (item in ("=", ":", ":=")) + ["key"] * (word in _KEYS) + ["call"] * (word in _CALLS)
    return tuple(sorted(_AT[n] for n in found))


def labelled(rows: int = 700, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: lines of made-up words with made-up data among them, and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwéüñ") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", ",", ".", "!!", "###"])
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    tail = lambda: r.choice(["", "", "", ".", ",", "!!", "###", "***", "&&&", "$$$", "%%%"])

    def item() -> tuple[list[str], list[str]]:
        k = r.randrange(20)
        if k < 3:
            name = r.choice([word().strip(",.!#"), word().strip(",.!#") + "." + digits(2), word().strip(",.!#") + "_" + digits(1)])
            return [name + "@" + r.choice(["mail", "post", "x"]) + r.choice(["", digits(1)]) + "." + r.choice(["example.com", "org", "net", "co.uk"]) + tail()], ["EMAIL"]
        if k < 6:
            parts = r.choice([["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(2)}{digits(9)}"], ["+" + digits(2), digits(3), f"{digits(3)}-{digits(4)}"], [f"+1-{digits(3)}-{digits(3)}-{digits(4)}"]])
            glue = r.random() < 0.15
            if glue:
                parts = [p + "###" for p in parts]
            parts[-1] += tail()
            return parts, ["B-PHONE"] + ["I-PHONE"] * (len(parts) - 1)
        if k < 9:
            parts = r.choice([[digits(16)], [digits(16)], [digits(15)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))]])
            parts[-1] += tail()
            return parts, ["B-CARD"] + ["I-CARD"] * (len(parts) - 1)
        if k < 11:
            return [".".join(str(r.randint(0, 255)) for _ in range(4)) + tail()], ["IP"]
        if k < 13:
            value = r.choice([hexes(40), hexes(32), hexes(40).upper(), "sk" + hexes(24), "AKIA" + hexes(16).upper()])
            quote = r.choice(['"', '"', ""])
            if r.random() < 0.7:
                t = r.choice(["", "", "###", "!!"])
                return [r.choice(["token", "key", "secret", "password", "TOKEN"]) + t, "=" + t, quote + value + quote + tail()], ["O", "O", "SECRET"]
            return [quote + value + quote + tail()], ["SECRET"]
        v = r.choice([digits(1), digits(2), digits(3), str(r.randint(1900, 2030)), digits(5), digits(7), f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 12)}:{digits(2)}", f"{digits(3)}.{digits(2)}.", "#" + digits(6), digits(2) + "%", word() + digits(2), f"{digits(2)}.{digits(3)}", "@" + word(), "v" + digits(1), digits(8), f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2024)}"])
        return [v], ["O"]

    out = []
    for _ in range(rows):
        items: list[str] = []
        tags: list[str] = []
        for _ in range(r.randint(1, 3)):
            n = r.randint(0, 4)
            items += [word() for _ in range(n)]
            tags += ["O"] * n
            if r.random() < 0.8:
                a, b = item()
                items += a
                tags += b
        if items:
            out.append((items, tags))
    return out


def design(lines: list[list[str]]) -> list[np.ndarray]:
    """For each line an array (items, 3, D) of 0 and 1: own features, those of the item before, and after."""
    out = []
    for items in lines:
        own = np.zeros((len(items), D), np.float32)
        for i, x in enumerate(items):
            own[i, list(shape(x))] = 1
        edge = np.zeros((1, D), np.float32)
        edge[0, _AT["edge"]] = 1
        out.append(np.stack([own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])], 1))
    return out


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 120, rate: float = 0.25, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights (3, D, L) and transitions (L, L): Adam on the L2-regularised log likelihood of the rows."""
    # lines of one length go through the sums together
    by: dict[int, list[int]] = {}
    for i, (items, _) in enumerate(rows):
        by.setdefault(len(items), []).append(i)
    xs = design([x for x, _ in rows])
    groups = [(np.stack([xs[i] for i in who]), np.array([[TAGS.index(t) for t in rows[i][1]] for i in who])) for who in by.values()]
    w, t = np.zeros((3, D, L)), np.zeros((L, L))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for k in range(1, rounds + 1):
        gw, gt = -l2 * w * len(rows) / 100, -l2 * t * len(rows) / 100
        for x, y in groups:
            e = np.einsum("bnkd,kdl->bnl", x, w)
            n = e.shape[1]
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for i in range(1, n):
                v = a[:, i - 1][:, :, None] + t
                m = v.max(1)
                a[:, i] = e[:, i] + m + np.log(np.exp(v - m[:, None]).sum(1))
            for i in range(n - 2, -1, -1):
                v = t + (e[:, i + 1] + b[:, i + 1])[:, None]
                m = v.max(2)
                b[:, i] = m + np.log(np.exp(v - m[:, :, None]).sum(2))
            z = a[:, -1].max(1)
            z = z + np.log(np.exp(a[:, -1] - z[:, None]).sum(1))
            p = np.exp(a + b - z[:, None, None])
            hot = np.eye(L)[y]
            gw += np.einsum("bnkd,bnl->kdl", x, hot - p)
            for i in range(1, n):
                pair = np.exp(a[:, i - 1][:, :, None] + t + (e[:, i] + b[:, i])[:, None] - z[:, None, None])
                gt += np.einsum("bi,bj->ij", hot[:, i - 1], hot[:, i]) - pair.sum(0)
        for g, at, v in ((gw, 0, w), (gt, 2, t)):
            g = g / len(rows)
            state[at] = 0.9 * state[at] + 0.1 * g
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * g * g
            v += rate * (state[at] / (1 - 0.9**k)) / (np.sqrt(state[at + 1] / (1 - 0.99**k)) + 1e-8)
    return w, t


@cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled())


def decode_all(model: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether a line without digit and at sign might be tagged other than O by these weights."""
    w, t = model
    plain = [_AT["bias"], _AT["no_digit"]]
    free = [_AT[n] for n in ("assign", "key", "call")]
    lead = np.inf
    for tag in range(1, L):
        gap = w[:, :, 0] - w[:, :, tag]
        own = gap[0, plain].sum() + np.minimum(gap[0, free], 0).sum()
        sides = sum(min(gap[s, plain].sum() + np.minimum(gap[s, free], 0).sum(), gap[s, _AT["edge"]]) for s in (1, 2))
        lead = min(lead, own + sides)
    # whatever the path, leaving O for some items gains at most so much by transitions, an item
    gain = max(t[i, j] for i in range(L) for j in range(L)) - t[0, 0]
    return not lead > 2 * max(gain, 0)


def viterbi(emissions: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best tags (lines, items) of padded emissions (lines, items, L), lines in order of falling length."""
    lines, n, _ = emissions.shape
    back = np.zeros((n, lines, L), np.int8)
    score = emissions[:, 0].copy()
    live = lines
    for i in range(1, n):
        live = int(np.searchsorted(-lengths, -i, side="left"))  # lines longer than i
        best, who = score[:live, :1] + t[0], np.zeros((live, L), np.int8)
        for k in range(1, L):
            other = score[:live, k : k + 1] + t[k]
            better = other > best
            best = np.where(better, other, best)
            who[better] = k
        back[i, :live] = who
        score[:live] = best + emissions[:live, i]
    tags = np.zeros((lines, n), np.int8)
    now = score.argmax(1)
    for i in range(n - 1, -1, -1):
        on = lengths > i
        tags[on, i] = now[on]
        if i:
            now = np.where(on, back[i, np.arange(lines), now], now)
    return tags


class Decoder:
    def __init__(self, model: tuple[np.ndarray, np.ndarray]) -> None:
        self.w, self.t = model
        self.all = decode_all(model)
        self.cache: dict[str, np.ndarray] = {}
        self.edge = [self.w[s, _AT["edge"]] for s in (1, 2)]

    def item(self, x: str) -> np.ndarray:
        got = self.cache.get(x)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[x] = self.w[:, list(shape(x))].sum(1)
        return got

    def emissions(self, items: list[str]) -> np.ndarray:
        v = np.stack([self.item(x) for x in items])
        e = v[:, 0].copy()
        e[1:] += v[:-1, 1]
        e[:-1] += v[1:, 2]
        e[0] += self.edge[0]
        e[-1] += self.edge[1]
        return e

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """For each text the (start, end, kind) of its findings, in characters."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        lines = []
        for d, text in enumerate(texts):
            if not text or not (self.all or _SOME.search(text)):
                continue
            for m in _LINE.finditer(text):
                if self.all or _SOME.search(m.group()):
                    items = [(x.start() + m.start(), x.group()) for x in _ITEM.finditer(m.group())]
                    if items:
                        lines.append((d, items))
        lines.sort(key=lambda x: -len(x[1]))
        at = 0
        while at < len(lines):
            n = len(lines[at][1])
            some = lines[at : at + max(1, 400_000 // n)]
            e = np.zeros((len(some), n, L))
            lengths = np.array([len(x) for _, x in some])
            for k, (_, items) in enumerate(some):
                e[k, : len(items)] = self.emissions([x for _, x in items])
            for (d, items), tags in zip(some, viterbi(e, lengths, self.t)):
                for i in np.flatnonzero(tags[: len(items)]).tolist():
                    kind = TAGS[tags[i]]
                    start, end = self.core(*items[i], kind)
                    if kind[:2] == "I-" and i and TAGS[tags[i - 1]][2:] == kind[2:] and out[d]:
                        out[d][-1] = (out[d][-1][0], end, kind[2:])
                    else:
                        out[d].append((start, end, kind.split("-")[-1]))
            at += len(some)
        return [sorted(x) for x in out]

    @staticmethod
    def core(at: int, item: str, kind: str) -> tuple[int, int]:
        """The item without punctuation around it, and of an assignment the value."""
        m = _CORE.match(item)
        a, b = m.start(1), m.end(1)
        if kind == "SECRET" and "=" in item[a:b].rstrip("="):
            a += item[a:b].index("=") + 1
            while a < b and item[a] in "\"'":
                a += 1
        return (at + a, at + b) if b > a else (at, at + len(item))


FOUND = "doc_id long, start long, `end` long, kind string"


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, kind): each finding's place in characters from 0, end exclusive."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for b in batches:
            rows = [(i, *s) for i, spans in zip(b.column("doc_id").to_pylist(), decoder.spans(b.column("text").to_pylist())) for s in spans]
            if rows:
                i, s, e, k = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(k, pa.string())], names=["doc_id", "start", "end", "kind"])

    lean(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not decode_all(model):
        slim = slim.where(F.col("text").rlike("[0-9@]"))  # the others don't leave the JVM
    return slim.mapInArrow(run, FOUND)


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, text: str = "text") -> DataFrame:
    """docs with each finding replaced by its kind in angle brackets."""
    model = model or default_model()

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        values = [None if x is None else x for x in texts.tolist()]
        out = []
        for t, spans in zip(values, Decoder(model).spans(values)):
            for a, b, k in reversed(spans):
                t = f"{t[:a]}<{k}>{t[b:]}"
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, F.when(F.col(text).rlike("[0-9@]") if not decode_all(model) else F.col(text).isNotNull(), replace(F.col(text))).otherwise(F.col(text)))
