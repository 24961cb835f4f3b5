"""Column functions over text: identity, writing systems, lines, links, redaction, shortening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code-point ranges, as Java regular-expression classes, that decide a text's class.
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}"
KANA = r"\x{3040}-\x{30fa}\x{30fd}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9f}"
HANGUL = r"\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{ac00}-\x{d7af}"
LATIN = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
OTHER = r"\x{370}-\x{10ff}\x{1200}-\x{139f}\x{1780}-\x{17ff}"

# JavaScript's \b knows ASCII word characters only; these lookarounds say the same in Java.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# What analyzers look for.
INSTALLERS = ("npm install", "npm i", "npx", "pip install", "pip3 install", "uvx", "brew install", "uv add", "uv pip install", "bunx")
REMOTE_EXECUTION = {
    "curl | sh": rf"{EDGE}curl{EDGE}[^\n|]*\|\s*(?:sudo\s+)?(?:sh|bash){EDGE}",
    "wget && sh": rf"{EDGE}wget{EDGE}[^\n&]*&&\s*(?:sh|bash){EDGE}",
    "iwr | iex": rf"(?i){EDGE}(?:iwr|Invoke-WebRequest){EDGE}[^\n|]*\|\s*iex{EDGE}",
}
# A line with one of these verbs asks for its addresses; the first in this order names the request.
FETCH_VERBS = ("WebFetch", "WebSearch", "Fetch from", "GET", "POST", "PUT", "DELETE", "Navigate to", "Open", "curl", "wget", "requests.get", "axios")
# First segments of the code host's addresses that are no accounts.
RESERVED_OWNERS = "about apps codespaces collections contact enterprise events explore features issues join login marketplace new notifications orgs pricing pulls search security settings sponsors stars topics trending users".split()
ADDRESS_END = r"\s<>()\[\]\"'`"


def content_hash(body: Column) -> Column:
    """SHA-256 of the body with CRLF as LF; null for null."""
    return F.sha2(F.replace(body, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)


#: Shares and numbers that decide between classes.
LEAST_CJK_SHARE, LEAST_KANA_SHARE, LEAST_HANGUL_SHARE, LEAST_CJK_ALONE, SENTENCE_WORDS = 0.1, 0.1, 0.5, 4, 6


def letters_by_script(text: Column) -> Column:
    """struct<han, kana, hangul, latin, other> of numbers of letters: runs of all other characters are
    taken out and the rest is measured, in texts that have such a letter at all."""
    scripts = {"han": HAN, "kana": KANA, "hangul": HANGUL, "latin": LATIN, "other": OTHER}
    return F.struct(*(F.when(text.rlike(f"[{r}]"), F.length(F.regexp_replace(text, f"[^{r}]+", ""))).otherwise(0).alias(name) for name, r in scripts.items()))


def writing_system(text: Column) -> Column:
    """latin, zh, ja, ko, mixed, other, unknown, or null for null and blank.

    A share of CJK letters below the least leaves the larger of the other scripts. Above it a run of
    Latin words makes a text mixed; else Hangul, Kana and Han are asked in turn, each by its share."""
    n = letters_by_script(text)
    cjk, rest = n["han"] + n["kana"] + n["hangul"], n["latin"] + n["other"]
    word, gap = f"[{LATIN}][{LATIN}0-9'._/-]*", r"[,;:!?\"()]*\s+"
    in_sentence = text.rlike(f"({word}{gap}){{{SENTENCE_WORDS - 1}}}[{LATIN}]")
    alone = F.when(text.rlike(f"[{LATIN}]"), "latin").otherwise("unknown")
    alphabetic = F.when(n["other"] == 0, alone).when(n["latin"] >= n["other"], "latin").otherwise("other")
    asian = F.when(n["hangul"] >= LEAST_HANGUL_SHARE * cjk, "ko").when(n["kana"] >= LEAST_KANA_SHARE * cjk, "ja").when(cjk >= LEAST_CJK_ALONE, "zh").otherwise("unknown")
    by_letters = F.when((cjk == 0) | (cjk < LEAST_CJK_SHARE * (cjk + rest)), alphabetic).otherwise(F.when(in_sentence, "mixed").otherwise(asian))
    return F.when(F.trim(text) != "", by_letters)


def visible_language(text: Column, hidden: list[str]) -> Column:
    """Whether a description of this text is shown when the classes in `hidden` are not."""
    if not hidden:
        return F.lit(True)
    return text.isNull() | ~text.rlike(f"[{HAN}{KANA}{HANGUL}]") | ~F.coalesce(writing_system(text), F.lit("")).isin(hidden)


def lines(body: Column, most: int = 2000) -> Column:
    """array<string>: lines at \\n without one trailing \\r, cut at `most`."""
    return F.transform(F.split(body, "\n", -1), lambda x: F.substring(F.regexp_replace(x, r"\r\z", ""), 1, most))


def install_directives(line: Column) -> Column:
    """array<string>: package-install commands of a line, as written."""
    return F.regexp_extract_all(line, F.lit(f"{EDGE}({'|'.join(INSTALLERS)}){EDGE}"), F.lit(1))


def network_addresses(line: Column) -> Column:
    """array<string>: http addresses of a line but those after `xmlns`, which name a namespace."""
    before = F.regexp_replace(line, r"(?is)xmlns.*\z", "")
    begun = F.size(F.regexp_extract_all(before, F.lit(rf"https?://(?=[^{ADDRESS_END}]|\z)"), F.lit(0)))
    return F.slice(F.regexp_extract_all(line, F.lit(rf"https?://[^{ADDRESS_END}]+"), F.lit(0)), F.lit(1), begun)


def fetch_verb(line: Column) -> Column:
    """The first fetch verb that the line holds, or null: a request if there is one, else a reference."""
    return F.coalesce(*(F.when(line.contains(v), v) for v in FETCH_VERBS))


def repository_of(url: Column) -> Column:
    """owner/name of an https address of the code host, lower-cased; null for others and reserved paths."""
    owner = F.regexp_extract(url, r"\Ahttps://github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]{1,100}?)(?:\.git)?(?:[/?#].*)?\z", 1)
    name = F.regexp_extract(url, r"\Ahttps://github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]{1,100}?)(?:\.git)?(?:[/?#].*)?\z", 2)
    return F.when((owner != "") & ~F.lower(owner).isin(*RESERVED_OWNERS), F.lower(F.concat_ws("/", owner, name)))


def links(markdown: Column) -> Column:
    """array<string>: https addresses of a text, without closing punctuation."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(r"https://[^\s<>()\[\]\"'`]{1,300}"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?*_\\]+\z", ""))


def redact_assignments(text: Column) -> Column:
    """Values of name = value with a sensitive name replaced; `$VAR` references stay."""
    return F.regexp_replace(text, r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)(?!\$)[A-Za-z0-9+/_.=-]+""", "$1[redacted]")


def compact_stars(n: Column) -> Column:
    """12400 as 12.4k: one decimal below 100k, none above, cut and never rounded up."""
    tenths = F.floor(n / 100)
    return F.when(n < 1000, n.cast("string")).when(n < 100_000, F.concat((tenths / 10).cast("decimal(10,1)").cast("string"), F.lit("k"))).otherwise(F.concat(F.floor(n / 1000).cast("string"), F.lit("k")))


def motes(n: Column) -> Column:
    """min(900, n)."""
    return F.least(F.lit(900), n)


def plates(n: Column) -> Column:
    """min(16, 1 + floor(log2 n)), 0 for none."""
    return F.when(n < 1, 0).otherwise(F.least(F.lit(16), 1 + F.length(F.bin(n)) - 1).cast("int"))


def capped(text: Column, most: int) -> Column:
    """text, or its first most - 1 characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def cap_summary(text: Column, most: int = 500) -> Column:
    """A summary without its credentials; a long one cut at a word, with the length and the head of the hash of what was there."""
    from tallyforge.functions import concealed

    shown = concealed.redacted(text)
    cut = F.regexp_replace(F.substring(shown, 1, most), r"\s+\S*\z", "")
    return F.when(F.length(shown) > most, F.concat(cut, F.lit(" … ("), F.length(text).cast("string"), F.lit(" characters, "), F.substring(F.sha2(text.cast("binary"), 256), 1, 8), F.lit(")"))).otherwise(shown)


def split_front_matter(source: Column) -> Column:
    """What stands between the fences at the very start, or null."""
    found = F.regexp_extract(source, r"(?s)\A\x{FEFF}?---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    return F.when(source.rlike(r"(?s)\A\x{FEFF}?---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"), found)
