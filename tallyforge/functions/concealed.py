"""What a text hides, and what it shouldn't show: hidden characters, comments outside code, credentials."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of hidden characters and the names that stand in for them.
HIDDEN = {
    "zero_width": r"\x{200b}-\x{200d}\x{feff}",
    "bidi_control": r"\x{202a}-\x{202e}\x{2066}-\x{2069}",
    "unicode_tag": r"\x{e0000}-\x{e007f}",
    "soft_hyphen": r"\x{ad}",
}
NAMES = {
    0x200B: "ZERO WIDTH SPACE",
    0x200C: "ZERO WIDTH NON-JOINER",
    0x200D: "ZERO WIDTH JOINER",
    0xFEFF: "ZERO WIDTH NO-BREAK SPACE",
    0xAD: "SOFT HYPHEN",
    0x202A: "LEFT-TO-RIGHT EMBEDDING",
    0x202B: "RIGHT-TO-LEFT EMBEDDING",
    0x202C: "POP DIRECTIONAL FORMATTING",
    0x202D: "LEFT-TO-RIGHT OVERRIDE",
    0x202E: "RIGHT-TO-LEFT OVERRIDE",
    0x2066: "LEFT-TO-RIGHT ISOLATE",
    0x2067: "RIGHT-TO-LEFT ISOLATE",
    0x2068: "FIRST STRONG ISOLATE",
    0x2069: "POP DIRECTIONAL ISOLATE",
}
# Names of credentials, the shapes of named values and flags, and the forms of tokens that their issuers document.
SENSITIVE = r"key|token|secret|passw|pwd|credential|signature|cookie|session|^auth$|^authorization$|^sig$|^bearer$"
TOKENS = (r"gh[pousr]_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"sk-[A-Za-z0-9_-]{16,}", r"sk_(?:live|test)_[A-Za-z0-9]{16,}", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"AKIA[0-9A-Z]{16}", r"AIza[0-9A-Za-z_-]{35}", r"glpat-[A-Za-z0-9_-]{20,}")
BLANK = "<redacted>"


def hidden_counts(text: Column) -> Column:
    """struct of the numbers of hidden characters by class; a byte order mark at the very start isn't hidden."""
    body = F.regexp_replace(text, r"\A\x{feff}", "")
    return F.struct(*(F.length(F.regexp_replace(body, f"[^{ranges}]", "")).alias(name) for name, ranges in HIDDEN.items()))


def shown(text: Column) -> Column:
    """text with each hidden character replaced by its number and name."""
    one = lambda t, kv: F.replace(t, F.lit(chr(kv[0])), F.lit(f"[U+{kv[0]:04X} {kv[1]}]"))
    named = F.when(text.rlike("[" + "".join(HIDDEN.values()) + "]"), reduce(one, NAMES.items(), text)).otherwise(text)
    # tags are told by their last two digits: a letter of ASCII each

    def tags_of(texts: pd.Series) -> pd.Series:
        return texts.map(_tags, na_action="ignore")

    tags = F.pandas_udf(tags_of, "string")
    return F.when(named.rlike(f"[{HIDDEN['unicode_tag']}]"), tags(named)).otherwise(named)


def _tags(text: str) -> str:
    return re.sub("[\U000e0000-\U000e007f]", lambda m: f"[U+{ord(m[0]):X} UNICODE TAG]", text)


def fence_flags(lines: Column) -> Column:
    """array<boolean>: whether each of an array of lines is in a fenced block, its two delimiter lines included.

    A line that begins with three backticks or tildes, at most three blanks before, opens or closes one."""
    none = F.struct(F.lit(False).alias("open"), F.array().cast("array<boolean>").alias("flags"))

    def step(acc: Column, line: Column) -> Column:
        fence = line.rlike(r"\A {0,3}(?:`{3}|~{3})")
        return F.struct((acc["open"] != fence).alias("open"), F.concat(acc["flags"], F.array(acc["open"] | fence)).alias("flags"))

    return F.aggregate(lines, none, step)["flags"]


def comment_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(first line, last line, column, what it says) of closed HTML comments that begin outside of code, lines from 1, columns from 0.

    A comment is told by where it begins: in a fenced block, or between two runs of backticks of one line, it is
    text that a reader sees. One that isn't closed is none."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    shut, code = [], []  # by line: whether in a fenced block, and spans of inline code
    fenced = False
    for line in text.split("\n"):
        fence = re.match(r" {0,3}(?:`{3}|~{3})", line) is not None
        shut.append(fenced or fence)
        fenced ^= fence
        ticks = [m.span() for m in re.finditer("`+", line)]
        code.append([(one[0], other[1]) for one, other in zip(ticks[::2], ticks[1::2])])
    out = []
    for m in re.finditer(r"<!--(.*?)-->", text, re.S):
        first, last = bisect_right(starts, m.start()), bisect_right(starts, m.end() - 1)
        column = m.start() - starts[first - 1]
        if not shut[first - 1] and not any(a <= column < b for a, b in code[first - 1]):
            out.append((first, last, column, m[1].strip()))
    return out


def comments(text: Column) -> Column:
    """array<struct<start_line, end_line, column, says>> of comment_spans()."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [dict(zip(("start_line", "end_line", "column", "says"), c)) for c in comment_spans(t)])

    return F.pandas_udf(run, "array<struct<start_line:int,end_line:int,column:int,says:string>>")(text)


_KNOWN = re.compile(r"\b(?:" + "|".join(TOKENS) + r")\b", re.ASCII)
_LOGIN = re.compile(r"(?i)[a-z][a-z0-9+.-]*://[^\s/:@]+:([^\s/@]+)@")
_SCHEME = re.compile(r"\b(?:Bearer|Basic|Token)\s+([A-Za-z0-9._~+/=-]{8,})")
_NAME = re.compile(r"[A-Za-z0-9_.-]+")
_VARIABLE = re.compile(r"\$(?:[A-Za-z_]\w*|\{[A-Za-z_]\w*\})", re.ASCII)


class Reader:
    """Goes through a text name by name and tells what value each one is given."""

    def __init__(self, text: str):
        self.text = text

    def value_at(self, at: int, ends: str) -> tuple[int, int]:
        """The value that begins at a place: what is in quotes, if they are closed, else all before white space or one of `ends`."""
        quote = self.text[at : at + 1]
        if quote in ("'", '"') and quote and (close := self.text.find(quote, at + 1)) >= 0:
            return at, close + 1
        end = at
        while end < len(self.text) and not self.text[end].isspace() and self.text[end] not in ends:
            end += 1
        return at, end

    def given(self, name: re.Match) -> tuple[int, int] | None:
        """The value of a name: behind a sign right after it, or as the next word of a flag."""
        at, text = name.end(), self.text
        sign = text[at : at + 1]
        if sign == "=" or sign == ":" and not text.startswith("://", at):
            at += 1
            while sign == ":" and text[at : at + 1].isspace():
                at += 1
            return self.value_at(at, "&\"',;")
        if name[0].startswith("-") and sign.isspace():
            while text[at : at + 1].isspace():
                at += 1
            return None if text[at : at + 1] == "-" else self.value_at(at, "\"'" if text[at : at + 1] in "\"'" else "")
        return None

    def named(self) -> list[tuple[int, int, str]]:
        out, at = [], 0
        while (name := _NAME.search(self.text, at)) is not None:
            at = name.end()
            if is_sensitive(name[0]) and (span := self.given(name)) and tells(self.text[slice(*span)]):
                out.append((*span, "flag" if name[0].startswith("-") and self.text[name.end()].isspace() else "name"))
                at = span[1]
        return out


def is_sensitive(name: str) -> bool:
    """Whether what a name or a flag is given is a credential."""
    return re.search(SENSITIVE, name.lower().lstrip("-")) is not None


def tells(value: str) -> bool:
    """Whether a value gives a secret away: not if it is empty or blank, a variable, or the word that a scheme's token follows."""
    bare = value[value[:1] in ("'", '"') : len(value) - (value[-1:] in ("'", '"'))]
    return bare not in ("", BLANK, "Bearer", "Basic", "Token") and _VARIABLE.fullmatch(bare) is None


def credentials(text: str) -> list[tuple[int, int, str]]:
    """(start, end, reason) of what a text gives away, in order, none over another. Every kind is looked for in the text as it is;
    spans that meet become one, with the first one's reason."""
    found = [(*m.span(1), "address") for m in _LOGIN.finditer(text)] + [(*m.span(1), "scheme") for m in _SCHEME.finditer(text)]
    found += [(*m.span(), "known form") for m in _KNOWN.finditer(text)] + Reader(text).named()
    out: list[tuple[int, int, str]] = []
    for start, end, reason in sorted(found):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((start, end, reason))
    return out


def without_secrets(text: str) -> str:
    """The text with each of its credentials blanked."""
    at, kept = 0, []
    for start, end, _ in credentials(text):
        kept += [text[at:start], BLANK]
        at = end
    return "".join([*kept, text[at:]])


def without_secret_arguments(arguments: list[str | None]) -> list[str | None]:
    """An argument vector: what an element gives away by itself, and an element that a sensitive flag alone stands before."""
    flags = [a is not None and a.startswith("-") and _NAME.fullmatch(a) is not None and is_sensitive(a) for a in arguments]
    given = [False, *flags[:-1]]
    return [a if a is None else BLANK if told and not a.startswith("-") and tells(a) else without_secrets(a) for a, told in zip(arguments, given)]


_SIGN = r"(?i)key|token|secret|passw|pwd|credential|signature|cookie|session|auth|sig|bearer|basic|://[^\s/:@]+:|gh[pousr]_|sk[-_]|xox|AKIA|AIza|glpat"


def redacted(text: Column) -> Column:
    """text without its credentials; only rows with a sign of one reach Python."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(without_secrets, na_action="ignore")

    return F.when(text.rlike(_SIGN), F.pandas_udf(run, "string")(text)).otherwise(text)


def redacted_arguments(arguments: Column) -> Column:
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda a: None if a is None else without_secret_arguments(list(a)))

    return F.pandas_udf(run, "array<string>")(arguments)
