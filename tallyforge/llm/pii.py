"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. Around every trigger (an @, an "at" in brackets, a plus sign, a
run of digits) the field segments the tokens into spans of up to `LONGEST` tokens and single outside
tokens: features look at a whole candidate span (digit groups, separators, checksum, words before
it), and dynamic programming over span ends, lengths and types picks boundaries and types together.
Spans that the field finds and that no base span touches are added.

The field is trained here, by gradient ascent on the conditional likelihood of generated sentences
(`SENTENCES` of them, fixed seed). Null text counts as empty. Offsets are code points, end exclusive.
Whole texts are scanned; a window ends only where no token of interest follows for a while.

Repeated rows are scanned as often as they occur. Segmentations of equal score: the shorter span, then the kind that comes first. An
empty table gives an empty result. Other columns aren't read, so they may have any names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

KINDS = ("email", "ip", "card", "phone")
TYPES = ("outside", *KINDS)
LONGEST, SENTENCES, SEED = 11, 160, 7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"@|\+[0-9]|[0-9][0-9() .-]{5,}[0-9]|[\[({] ?(?:at|AT) ?[\])}]")
#: Words that often stand before a span, by kind.
CUES = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "amex", "payment", "pan"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telephone"},
}


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ so that long runs cost linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at + 1)):
            start, low = at, max(done, at - 64)
            while True:  # the local part reaches back to the last other character, or the last match
                stops = [x.end() for x in _NOT_LOCAL.finditer(text, low, at)]
                start = stops[-1] if stops else low
                if stops or low == done:
                    break
                low = max(done, at - 2 * (at - low))
            if start < at:
                out.append((start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str, maybe_ip: bool = True, maybe_card: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if maybe_ip:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    if maybe_card:
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def windows(text: str, reach: int = 60) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers, wide enough for a span and its cues; near ones join."""
    low = high = -1
    for m in _TRIGGER.finditer(text):
        s, e = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if s <= high:
            high = e
        else:
            if high >= 0:
                yield low, high
            low, high = s, e
    if high >= 0:
        yield low, high


class Tokens:
    """The tokens of a window as arrays, from which features of all its spans follow."""

    def __init__(self, text: str, low: int, high: int):
        found = list(_TOKEN.finditer(text, low, high))
        self.start = np.array([m.start() for m in found], np.int64)
        self.end = np.array([m.end() for m in found], np.int64)
        self.text = [m[0] for m in found]
        self.gap = ["", *[text[a.end() : b.start()] for a, b in zip(found, found[1:])]]


def features(tokens: Tokens) -> np.ndarray:
    """float32 [end, length - 1, feature] of the span of `length` tokens that ends at token `end`."""
    n, words = len(tokens.text), tokens.text
    digits = np.array([len(w) if w[0] in "0123456789" else 0 for w in words])
    letters = np.array([w.isalpha() for w in words])
    dots, ats, plus, dash, paren = (np.array([w in s for w in words]) for s in (".", "@", "+", "-", "()"))
    spelled = np.array([w.lower() in ("at", "dot") for w in words])
    wide = np.array([len(g) > 1 or "\n" in g for g in tokens.gap])
    spaced = np.array([bool(g) for g in tokens.gap])
    odd = np.array([not (w[0].isalnum() or w in ".@+-()_[]{}") for w in words])
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (digits, digits > 0, letters, dots, ats, plus, dash, paren, spelled, wide, spaced, odd)]
    cue = np.zeros((len(KINDS), n + 1))
    for k, kind in enumerate(KINDS):
        near = np.array([w.lower() in CUES[kind] for w in words])
        for back in range(1, 5):
            cue[k, back:] = np.maximum(cue[k, back:], near[: n + 1 - back])
    out = np.zeros((n, LONGEST, 27), np.float32)
    for length in range(1, min(LONGEST, n) + 1):
        i = np.arange(length - 1, n)
        s, e = i - length + 1, i + 1
        d, groups, let, dot, at, pl, da, pa_, sp, wi, _, od = (x[e] - x[s] for x in sums)
        gaps = sums[9][e] - sums[9][np.minimum(s + 1, e)]
        inner = sums[10][e] - sums[10][np.minimum(s + 1, e)]
        ends_well = (digits[i] > 0) | letters[i]
        starts_well = (digits[s] > 0) | letters[s] | plus[s] | (paren[s] & (length > 1))
        ip = np.zeros(len(i))
        check = np.zeros(len(i))
        if length == 7:
            for j in np.flatnonzero((groups == 4) & (dot == 3)):
                ip[j] = all(0 < digits[t] <= 3 and int(words[t]) <= 255 for t in range(s[j], e[j], 2))
        for j in np.flatnonzero((d >= 13) & (d <= 19) & (let == 0) & (pl == 0)):
            check[j] = luhn("".join(words[t] for t in range(s[j], e[j]) if digits[t]))
        columns = (
            np.ones(len(i)), length == 1, length > 1, d == 0, (d > 0) & (d < 7), (d >= 7) & (d <= 9), (d >= 10) & (d <= 12), (d >= 13) & (d <= 16), d > 16,
            at == 1, (at == 1) & (dot >= 1) & (let >= 2), (sp >= 2) & (let >= 4), let > 0, pl > 0, plus[s], da + pa_ > 0, dot > 0, gaps > 0, od > 0,
            ~ends_well, ~starts_well, ip, check, *(cue[k][s] for k in range(4)),
        )
        out[i, length - 1] = np.stack([np.broadcast_to(np.asarray(c, np.float32), len(i)) for c in columns], axis=1)
    return out


def _allowed(n: int) -> np.ndarray:
    """0 or -inf for [end, length - 1, type]: spans stay in the window, outside is one token."""
    mask = np.zeros((n, LONGEST, len(TYPES)))
    mask[np.arange(n)[:, None] < np.arange(LONGEST)[None, :]] = -np.inf
    mask[:, 1:, 0] = -np.inf
    return mask


def best_spans(tokens: Tokens, weights: np.ndarray, moves: np.ndarray) -> list[tuple[int, int, int]]:
    """(type, first token, end token) of the best segmentation."""
    n = len(tokens.text)
    if not n:
        return []
    score = features(tokens) @ weights + _allowed(n)
    best = np.full((n + 1, len(TYPES)), -np.inf)
    best[0, 0] = 0
    back = np.zeros((n + 1, len(TYPES), 2), np.int32)
    for e in range(1, n + 1):
        most = min(LONGEST, e)
        into = best[e - most : e][::-1][:, :, None] + moves  # [length - 1, type before, type]
        before = into.argmax(axis=1)
        total = into.max(axis=1) + score[e - 1, :most]
        length = total.argmax(axis=0)
        best[e] = total[length, np.arange(len(TYPES))]
        back[e, :, 0] = length + 1
        back[e, :, 1] = before[length, np.arange(len(TYPES))]
    out, e, t = [], n, int(best[n].argmax())
    while e > 0:
        length, before = back[e, t]
        if t:
            out.append((t, e - int(length), e))
        e, t = e - int(length), int(before)
    return out[::-1]


def generated_sentences(count: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with labelled spans, and as many look-alikes that are no personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        digits = num(r.choice([14, 15, 15, 15]))
        digits += next(c for c in "0123456789" if luhn(digits + c))
        sep = r.choice(["", " ", "-"])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def email() -> str:
        name, host, top = r.choice([word(), f"{word()}.{word()}", f"{word()}{num(2)}"]), word(), r.choice(["com", "org", "net", "de"])
        return r.choice([f"{name}@{host}.{top}"] * 2 + [f"{name} [at] {host} [dot] {top}", f"{name} (at) {host} (dot) {top}", f"{name} @ {host}.{top}"])

    def phone() -> str:
        return r.choice([f"+{num(2)} {num(3)} {num(7)}", f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])

    make = {"email": email, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    lookalikes = [lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"v{num(1)}.{num(2)}.{num(1)}", lambda: num(r.randint(1, 12)), lambda: f"${num(3)}.{num(2)}", lambda: f"{num(4)} {num(4)} {num(4)}", lambda: f"{num(2)}:{num(2)}", lambda: f"@{word()}", lambda: f"page {num(3)}", lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(2)}", lambda: f"id {num(r.randint(13, 20))}", lambda: f"meet (at) {word()}"]
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(r.randint(1, 5))), []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                if r.random() < 0.5:
                    text += " " + r.choice(sorted(CUES[kind])) + r.choice(["", ":", " is"])
                value = make[kind]()
                text += " "
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += " " + r.choice(lookalikes)()
            text += r.choice(["", ",", "."]) + " " + " ".join(word() for _ in range(r.randint(1, 4)))
        out.append((text, spans))
    return out


@lru_cache(1)
def trained(rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights [feature, type], moves [type, type]) by gradient ascent on the mean log-likelihood.

    All sentences are padded to one length and run through forward and backward sums together."""
    cases = []
    for text, spans in generated_sentences():
        tokens = Tokens(text, 0, len(text))
        first = {int(s): i for i, s in enumerate(tokens.start)}
        last = {int(e): i + 1 for i, e in enumerate(tokens.end)}
        gold = sorted((first[s], last[e], TYPES.index(k)) for k, s, e in spans if last[e] - first[s] <= LONGEST)
        full, at = [], 0
        for s, e, t in [*gold, (len(tokens.text), 0, 0)]:
            full += [(i, i + 1, 0) for i in range(at, s)]
            if e:
                full.append((s, e, t))
                at = e
        cases.append((features(tokens), full))
    b, n, k, nf = len(cases), max(len(f) for f, _ in cases), len(TYPES), cases[0][0].shape[2]
    feats, mask = np.zeros((b, n, LONGEST, nf), np.float32), np.full((b, n, LONGEST, k), -1e30)
    size = np.array([len(f) for f, _ in cases])
    want_w, want_m = np.zeros((nf, k)), np.zeros((k, k))
    for c, (f, full) in enumerate(cases):
        feats[c, : len(f)], mask[c, : len(f)] = f, np.maximum(_allowed(len(f)), -1e30)
        before = 0
        for s, e, t in full:
            want_w[:, t] += f[e - 1, e - s - 1]
            want_m[before, t] += 1
            before = t
    add = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
    w, m = np.zeros((nf, k)), np.zeros((k, k))
    step_w, step_m = np.full_like(w, 1e-8), np.full_like(m, 1e-8)
    flat, every = feats.reshape(-1, nf), np.arange(b)
    for _ in range(rounds):
        score = (flat @ w.astype(np.float32)).reshape(b, n, LONGEST, k) + mask
        ahead, reach = np.full((b, n + 1, k), -1e30), np.full((b, n + 1, k), -1e30)  # sums up to a token, and with the move into the next type
        ahead[:, 0, 0] = 0
        for e in range(n + 1):
            if e:
                most = min(LONGEST, e)
                ahead[:, e] = add(reach[:, e - most : e][:, ::-1] + score[:, e - 1, :most], 1)
            reach[:, e] = add(ahead[:, e, :, None] + m, 1)
        behind, onward = np.full((b, n + 1, k), -1e30), np.full((b, n + 1, k), -1e30)
        behind[every, size] = 0
        for s in range(n - 1, -1, -1):
            d = np.arange(min(LONGEST, n - s))
            onward[:, s] = add(score[:, s + d, d] + behind[:, s + d + 1], 1)
            behind[:, s] = np.where((s < size)[:, None], add(onward[:, s, None, :] + m, 2), behind[:, s])
        z = add(ahead[every, size], 1)
        place = np.maximum(np.arange(n)[:, None] - np.arange(LONGEST)[None, :], 0)
        p = np.exp(np.minimum(0, reach[:, place] + score + behind[:, 1:, None, :] - z[:, None, None, None]))
        p[np.arange(n)[None, :] >= size[:, None]] = 0
        got_w = (flat.T @ p.reshape(-1, k).astype(np.float32)).astype(np.float64)
        inside = np.arange(n + 1)[None, :] < size[:, None]
        got_m = np.exp(np.minimum(0, ahead[:, :, :, None] + m + onward[:, :, None, :] - z[:, None, None, None]))[inside].sum(axis=0)
        grad_w, grad_m = (want_w - got_w) / b - decay * w, (want_m - got_m) / b - decay * m
        step_w += grad_w**2
        step_m += grad_m**2
        w += rate * grad_w / np.sqrt(step_w)
        m += rate * grad_m / np.sqrt(step_m)
    return w, m


def field_spans(text: str, model: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the field finds in the windows of a text."""
    out = []
    for low, high in windows(text):
        tokens = Tokens(text, low, high)
        out += [(t - 1, int(tokens.start[a]), int(tokens.end[b - 1])) for t, a, b in best_spans(tokens, *model)]
    return out


def find_pii(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, base array<struct<kind,start,stop>>, spans likewise with those of the field[, text])."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").fill_null("")
            ips = pc.match_substring_regex(texts, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]").to_pylist()
            cards = pc.match_substring_regex(texts, "[0-9](?:[ -]?[0-9]){15}").to_pylist()
            triggers = pc.match_substring_regex(texts, _TRIGGER.pattern).to_pylist()
            bases, alls = [], []
            for text, ip, card, trigger in zip(texts.to_pylist(), ips, cards, triggers, strict=True):
                base = base_spans(text, ip, card)
                more = [x for x in field_spans(text, model) if not any(s < x[2] and x[1] < e for _, s, e in base)] if trigger else []
                bases.append([{"kind": k, "start": s, "stop": e} for k, s, e in base])
                alls.append([{"kind": k, "start": s, "stop": e} for k, s, e in sorted(base + more)])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array(bases, kind), pa.array(alls, kind), *[texts] * with_text]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "base", "spans", *["text"] * with_text])

    span = "array<struct<kind:int,start:long,stop:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {span}, spans {span}" + ", text string" * with_text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, and n_chars counted anew.

    Overlapping spans are replaced as one, by the kind of the first. Null text stays null."""
    model = trained()

    def clean(text: str) -> str:
        spans = base_spans(text)
        spans += [x for x in field_spans(text, model) if not any(s < x[2] and x[1] < e for _, s, e in spans)]
        out, done = [], 0
        for k, s, e in sorted(spans, key=lambda x: x[1]):
            if s >= done:
                out += [text[done:s], f"<{KINDS[k].upper()}>"]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            odd = pc.match_substring_regex(texts, _TRIGGER.pattern).fill_null(False).to_pylist()  # what a base span holds is a trigger too
            new = [clean(t) if o else t for t, o in zip(texts.to_pylist(), odd, strict=True)]
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pii_query(docs: DataFrame) -> DataFrame:
    kinds = F.array(*map(F.lit, KINDS))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["stop"])), ",")
    return find_pii(docs).select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
