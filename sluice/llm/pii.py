"""Personal data: spans of e-mail addresses, IP addresses, card and telephone numbers.

Base spans follow fixed formats and always count. Besides, generators propose many more, overlapping spans (numbers in
other groupings, parts of longer runs of numbers, spelled-out addresses); boosted trees judge each by its format and
its context, and a threshold for each kind, calibrated on examples held back, selects. Where selected ones overlap,
the likelier stays; none overlaps a base span.

The trees learn from examples that are made here by templates from a fixed seed. What the generators propose is bounded
by what the kinds are, not by pieces or characters: local parts of 64 and labels of 63 characters, as addresses have at
most, numbers of 19 digits, whose groups are at most GAP separators apart.

Null text counts as empty, an empty table gives an empty one. Rows with repeated or null ids are searched each by itself.
Very long texts are searched whole, in time that grows with their length. Other columns don't matter, whatever their
names. Offsets are in code points, the end is exclusive.
"""

from __future__ import annotations

import bisect
import dataclasses
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions.arrow import tidy
from sluice.llm import boosting

KINDS = ("email", "ip", "card", "phone")
# fixed formats of the base spans; possessive repeats and the look-behind only keep long runs linear
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Runs of the characters that numbers are written with; every base number lies in one.
_ZONE = re.compile(r"[0-9][0-9 ().+/\[\]-]*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _zones(text: str):
    for m in _ZONE.finditer(text):
        a = m.start()
        yield (a - 1 if a and text[a - 1] == "+" else a), m.end()


def _numbers(zone: str, shift: int):
    """Base spans of a run: (kind, start, end)."""
    for m in _IP.finditer(zone) if zone.count(".") > 2 else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield 1, shift + m.start(), shift + m.end()
    for m in _CARD.finditer(zone):
        if m.end() - m.start() >= 13:
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                yield 2, shift + m.start(), shift + m.end()
    for m in _PHONE.finditer(zone) if "+" in zone else ():
        if 9 <= len(_digits(m.group())) <= 15:
            yield 3, shift + m.start(), shift + m.end()


# --- candidates -------------------------------------------------------------------------------------------------
#: Separators between two groups of a number at most, and digits that a number has at most.
GAP, DIGITS = 12, 19
_AT = re.compile(r" ?[(\[{] ?[aA][tT] ?[)\]}] ?| [aA][tT] | ?@ ?")
_DOT = r"(?: ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot |\.)"
_AFTER = re.compile(rf"[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+)++", re.I)
_SPELLED_IP = re.compile(r"(?<![0-9])[0-9]{1,3}+(?:(?: ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot | ?\. ?)[0-9]{1,3}+){3}(?![0-9])", re.I)
_GROUP = re.compile(r"[0-9]+")
#: Words before a span that speak for a kind, or for none.
_CONTEXT = {
    3: ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "teléfono", "téléphone", "contact", "sms", "dial", "ring"),
    2: ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte", "pan", "payment", "paid"),
    1: ("ip", "host", "server", "address", "login", "from", "client", "gateway"),
    0: ("mail", "email", "e-mail", "contact", "write", "reach", "correo", "send"),
    4: ("version", "v", "order", "invoice", "isbn", "page", "pages", "total", "sum", "id", "no", "nr", "section", "date", "price", "eur", "usd", "year", "serial", "sku"),
}
#: Last labels of the most common domains.
_TLDS = frozenset("com org net edu gov de fr es uk io info example eu".split())
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@dataclasses.dataclass
class Candidate:
    kind: int
    start: int
    end: int


class _Taken:
    """Places that spans have, none of which overlap."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        i = bisect.bisect_left(self.starts, e)
        return i > 0 and self.ends[i - 1] > s

    def add(self, s: int, e: int) -> None:
        i = bisect.bisect_left(self.starts, s)
        self.starts.insert(i, s)
        self.ends.insert(i, e)


def _addresses(text: str):
    """Spelled-out e-mail addresses: a local part, what stands for @, labels with what stands for dots."""
    low = 0
    for m in _AT.finditer(text):
        after = _AFTER.match(text, m.end())
        if not after:
            continue
        start = m.start()
        while start > max(low, m.start() - 64) and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start() and (start == 0 or text[start - 1] not in _LOCAL_CHARS):
            yield Candidate(0, start, after.end())
            low = after.end()


def _of_run(text: str, a: int, z: int):
    """Numbers of groups that follow one another in a run, with the brackets and signs around them."""
    groups = [m.span() for m in _GROUP.finditer(text, a, z)]
    for i, (s, _) in enumerate(groups):
        if text[s - 1 : s].isalnum():
            continue
        first = s
        while first > 0 and s - first < 2 and text[first - 1] in "+(":
            first -= 1
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > DIGITS or j > i and groups[j][0] - groups[j - 1][1] > GAP:
                break
            e = groups[j][1]
            if n < 4 or text[e : e + 1].isalnum():  # part of a code, not a number
                continue
            body = text[first:e]
            if 7 <= n <= 15:
                yield Candidate(3, first, e)
                if first < s and "(" in body and ")" not in body or body[:2] == "(+":  # what is before doesn't belong to it
                    yield Candidate(3, s, e)
            if 13 <= n <= 19 and "(" not in body and "+" not in body:
                yield Candidate(2, s, e)


def _candidates(text: str, zones: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[Candidate]:
    """Spans that may be personal data: kinds and places overlap."""
    out = list(_addresses(text))
    if zones:
        out += [Candidate(1, *m.span()) for m in _SPELLED_IP.finditer(text)]
    for a, z in zones:
        if z - a > 6:
            out += _of_run(text, a, z)
    held = _Taken(taken)
    return [c for c in out if not held.meets(c.start, c.end)]


def features(text: str, c: Candidate) -> list[float]:
    """Of the format, then of the context."""
    body = text[c.start : c.end]
    d = _digits(body)
    groups = [len(g) for g in re.findall("[0-9]+", body)]
    before = text[max(0, c.start - 40) : c.start]
    last = re.split(r"[^A-Za-z]+", body)[-1].lower() if c.kind == 0 else ""
    words = [w.lower() for w in _WORDS.findall(before)[-3:]]
    left, right = before[-1:], text[c.end : c.end + 1]
    more_left = bool(re.search(r"[0-9][ ().-]{0,2}$", before[-4:]))
    more_right = bool(re.match(r"[ ().-]{0,2}[0-9]", text[c.end : c.end + 4]))
    same = lambda *g: float(groups == list(g))
    return [
        *(float(c.kind == k) for k in range(4)),
        float(len(d)),
        float(len(groups)),
        float(luhn(d)) if c.kind == 2 else 0.0,
        float(body[:1] == "+"),
        float(body[:2] == "00"),
        float(body[:1] == "0"),
        float("(" in body and ")" in body),
        float(body.count("(") != body.count(")")),
        float(body.count(" ")),
        float(body.count("-")),
        float(body.count(".")),
        float(body.count("/")),
        max([same(3, 3, 4), same(1, 3, 3, 4), same(3, 4)]),
        max([same(4, 4, 4, 4), same(4, 6, 5), same(4, 4, 4, 4, 3)]),
        float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0),
        float(max(groups, default=0)),
        float(bool(re.fullmatch(r"(?:19|20)\d\d[-/. ]\d\d?[-/. ]\d\d?(?:[ T].*)?|\d\d?[-/. ]\d\d?[-/. ](?:19|20)\d\d|(?:19|20)\d\d ?- ?(?:19|20)\d\d", body))),
        float(all(int(g) <= 255 for g in re.findall("[0-9]+", body)) if c.kind == 1 else 0),
        float(len(re.findall(r"\bdot\b|\[\.\]|\(\.\)", body, re.I))),
        float(len(re.findall(r"[(\[{] ?at ?[)\]}]", body, re.I))),
        float(last in _TLDS),
        float(len(last)),
        float(len(re.findall(r" dot |\. | \.", body, re.I))),
        float(bool(re.match(r"(?:look|see|meet|arrive|stay|work|live|sit|stand|start|stop|is|was|are|and|be|it|them|us|me|now)\b", body, re.I))) if c.kind == 0 else 0.0,
        float("@" in body),
        float(d[:1] in "3456" if d else 0),
        float(len(body)),
        *(float(any(w in _CONTEXT[k] for w in words)) for k in range(5)),
        float(any(w in _CONTEXT[c.kind] for w in words)),
        float(left.isalnum()),
        float(right.isalnum()),
        float(left in "$€£#" if left else 0),
        float(more_left),
        float(more_right),
        float(left in "([" and right in ")]" if left and right else 0),
    ]


# --- examples ---------------------------------------------------------------------------------------------------
def _luhn_number(rng: random.Random, n: int) -> str:
    head = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(head + c for c in "0123456789" if luhn(head + c))


def _example(rng: random.Random) -> tuple[str, tuple[int, int, int] | None]:
    """A text, and the (kind, start, end) of the personal data in it, if any."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))
    a, b, c, d = (rng.choice("23456789") + num(2), num(3), num(4), num(2))
    kind = rng.choice([3, 3, 2, 1, 0, None, None, None])
    if kind == 3:
        # US-like numbers, national ones with a trunk zero, and international ones
        body = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{d} {a} {b} {c}", f"0{d} {b} {c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a} {b}-{c}", f"+{d}{a}{b}{c}", f"+{d}.{a}.{b}.{c}", f"+{d} ({a}) {b}-{c}", f"+{d} {a[0]} {b} {c}", f"0{d} {b[:2]} {c[:2]} {c[2:]} {b[1:]}", f"({a}) {b}-{c[:2]}-{c[2:]}", f"0{a}/{b}{c}", f"0{a} {b}{d}{d}", f"00{d} {a} {b} {c}", f"+{d}-{a}-{b}-{c}", f"0{d}-{b}-{c}"])
    elif kind == 2:
        n = _luhn_number(rng, rng.choice([13, 15, 16, 16, 16, 19]))
        body = rng.choice([n, n, n, "  ".join(n[i : i + 4] for i in range(0, len(n), 4)), " - ".join(n[i : i + 4] for i in range(0, len(n), 4)), f"{n[:4]} {n[4:10]} {n[10:]}", f"{n[:4]}/{n[4:8]}/{n[8:12]}/{n[12:]}", " ".join(n[i : i + 4] for i in range(0, len(n), 4)), "-".join(n[i : i + 4] for i in range(0, len(n), 4)), ".".join(n[i : i + 4] for i in range(0, len(n), 4))])
    elif kind == 1:
        p = [str(rng.randint(0, 255)) for _ in range(4)]
        body = rng.choice(["[.]", " . ", ".", ". ", " .", "(.)", "{.}", "[dot]", "(dot)", " dot ", " [.] ", " (dot) ", " [dot] "]).join(p)
    elif kind == 0:
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), ("{at}", "."), ("@ ", "."), (" @", "."), (" (AT) ", " (DOT) "), (" AT ", " DOT "), ("[at]", "."), (" at ", "."), ("@", " dot "), ("@", "[.]"), ("(at)", "(dot)"), ("{at}", "{dot}"), (" [at] ", ".")])
        user = word() + rng.choice(["", "." + word(), d, "_" + word()])
        body = f"{user}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'example' + dot + 'com', 'co' + dot + 'uk'])}"
    else:
        y = f"{rng.choice(['19', '20'])}{num(2)}"
        m, t = f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"
        junk = next(x for x in iter(lambda: rng.choice("123456789") + num(rng.choice([12, 13, 14, 15, 15, 15, 17])), "") if not luhn(x))
        body = rng.choice([f"{y}-{m}-{t}", f"{t}.{m}.{y}", f"{t}/{m}/{y}", f"{y}-{y}", junk, junk, " ".join(junk[i : i + 4] for i in range(0, len(junk), 4)), num(rng.randint(7, 12)), f"{num(3)}.{num(3)}.{num(3)}", f"{num(2)}.{num(1)}.{num(1)}.{num(4)}", f"{num(1)}.{num(2)}.{num(1)}", f"{num(4)} {num(4)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{y}{m}{t}{num(6)}", f"{rng.choice(['look', 'see', 'meet us', 'is', 'it was', 'stop', 'works', 'we live'])} at {word()}{rng.choice([' dot ', '. ', '.'])}{word()}", f"{num(2)}. {num(1)}. {num(2)}. {num(2)} {num(4)}", f"{num(1)}.{num(1)}.{num(4)}.{num(3)}", f"{num(3)} {num(3)} {num(3)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(1)}.{num(7)}", f"{num(5)}/{num(5)}"])
    hints = _CONTEXT[4 if kind is None else kind]
    lead = rng.choice(["", "", "", rng.choice(hints) + rng.choice([" ", ": ", ": ", " is "])])
    tail = rng.choice(["", ".", ",", " " + word(), " " + word(), "!!", " |", " " + num(rng.choice([1, 2, 4, 16])) if rng.random() < 0.3 else " " + word()])
    front = f"{word()} {word()} " + (num(rng.choice([1, 2, 4, 16])) + " " if rng.random() < 0.1 and not lead else "")
    text = f"{front}{lead}{body}{tail} {word()}"
    if kind is None:
        return text, None
    start = len(front) + len(lead)
    return text, (kind, start, start + len(body))


@dataclasses.dataclass
class Model:
    trees: boosting.Trees
    thresholds: list[float]

    def find(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
        """Base spans (kind, start, end) and added ones (kind, start, end, probability), both in order."""
        base = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
        zones = list(_zones(text))
        for a, z in zones:
            if z - a > 6:
                base += _numbers(text[a:z], a)
        base.sort()
        found = _candidates(text, zones, [(s, e) for _, s, e in base])
        added: list[tuple[int, int, int, float]] = []
        if found:
            odds = self.trees.log_odds(np.array([features(text, c) for c in found]))
            held = _Taken()
            for i in np.argsort(-odds, kind="stable"):
                c = found[i]
                if odds[i] >= self.thresholds[c.kind] and not held.meets(c.start, c.end):
                    held.add(c.start, c.end)
                    added.append((c.kind, c.start, c.end, float(1 / (1 + np.exp(-odds[i])))))
        return base, sorted(added)


def fit(examples: int = 8000, precision: float = 0.96, seed: int = 7) -> Model:
    """Trees from examples by templates; on a quarter held back, each kind's threshold is the lowest that reaches the precision."""
    rng = random.Random(seed)
    x, y, kinds, held = [], [], [], []
    for i in range(examples):
        text, truth = _example(rng)
        for c in _candidates(text, list(_zones(text)), []):
            x.append(features(text, c))
            y.append(float((c.kind, c.start, c.end) == truth))
            kinds.append(c.kind)
            held.append(i % 4 == 0)
    x, y, kinds, held = np.array(x), np.array(y), np.array(kinds), np.array(held)
    trees = boosting.train(x[~held], y[~held])
    odds, thresholds = trees.log_odds(x), []
    for k in range(4):
        z, v = odds[held & (kinds == k)], y[held & (kinds == k)]
        order = np.argsort(-z)
        good = np.cumsum(v[order]) / np.arange(1, len(order) + 1) >= precision
        thresholds.append(max(0.0, float(z[order][np.flatnonzero(good)[-1]])) if good.any() else float("inf"))
    return Model(trees, thresholds)


_SPANS = "array<struct<kind: int, start: long, end: long, base: boolean, probability: double>>"
_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))


def _all(model: Model, text: str) -> list[tuple]:
    base, added = model.find(text)
    return sorted([(*b, True, 1.0) for b in base] + [(*a[:3], False, a[3]) for a in added])


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row of docs; a span has its kind's number, start, end, if it is a base one, and its probability."""
    model = model or fit()
    
    @tidy
    def run(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base", "probability"), s, strict=True)) for s in _all(model, t.as_py() or "")] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(spans, _TYPE)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs, with each span of personal data in text_col replaced by its kind in brackets; overlapping spans become one.

    length_col, if given, gets the new number of characters. Null texts stay null.
    """
    model = model or fit()
    
    def clean(text: str) -> str:
        out, at = [], 0
        for s, e, k in sorted((s[1], s[2], s[0]) for s in _all(model, text)):
            if s >= at:
                out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    names = docs.columns
    place = names.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            texts = [None if (v := t.as_py()) is None else clean(v) for t in batch.column(place)]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            if length_col:
                columns[names.index(length_col)] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.record_batch(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256, spans."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return find(docs).select("doc_id", *(count(k) for k in range(4)), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
