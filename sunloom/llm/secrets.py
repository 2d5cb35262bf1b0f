"""Secret scans: fixed patterns, and the guess cost of values in credential contexts.

The guess cost of a value is the cheapest way to cut it into dictionary words (any case, with common letter
substitutions), dates, repeats, keyboard walks, sequences and brute-force spans, as the decimal logarithm of the
guesses an attacker needs; a dynamic program over the value's positions finds it. Every piece but one multiplies the
guesses by a constant for the choice of the cut. A value in a credential context (``password: ...``, ``pwd is ...``)
whose cost reaches a threshold is a secret; cheaper values (``password: changeme``) are placeholders.

The dictionary is WORDS, then the words of a public tokenizer's vocabulary in its order, which is by frequency: a file
whose path is a parameter. Values that refer to a secret are none: ``${NAME}``, ``{{ name }}``, ``<name>``, ``name()``, and
``a.b.c`` of parts that are each cheap. After ``is`` a word of small letters alone is prose.

The program is linear in the value's length, so values are taken whole. Each text is scanned within its row.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

KINDS = ("assign", "access", "hex", "guess")
#: Costs from here on, as decimal logarithms of guesses, are secrets.
SECRET_COST = 8.0

# Frequent words of passwords and placeholders, most frequent first.
WORDS = (
    "password", "123456", "qwerty", "letmein", "admin", "welcome", "monkey", "dragon", "master", "login", "abc", "iloveyou", "sunshine",
    "princess", "football", "shadow", "superman", "michael", "baseball", "trustno", "secret", "hello", "freedom", "whatever", "starwars",
    "test", "testing", "example", "sample", "changeme", "change", "me", "default", "user", "guest", "root", "pass", "passwd", "token", "key",
    "api", "your", "my", "the", "here", "none", "null", "true", "false", "foo", "bar", "baz", "dummy", "fake", "placeholder", "redacted",
    "summer", "winter", "spring", "autumn", "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december", "monday", "friday", "sunday", "love", "money", "apple", "orange", "banana", "flower", "cookie",
    "pepper", "ginger", "hunter", "soccer", "hockey", "tiger", "lion", "eagle", "falcon", "phoenix", "matrix", "computer", "internet",
    "server", "database", "service", "account", "access", "private", "public", "value", "string", "name", "new", "old", "this", "that",
    "is", "not", "and", "for", "you", "with", "from", "house", "water", "green", "blue", "black", "white", "silver", "golden", "purple",
)
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
SUBSTITUTES = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CONTEXT = re.compile(r"""(?:passphrase|password|passwd|passcode|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key)["']?(?:\x20*[:=]|(\x20+is\b))\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"']+))""", re.A | re.I)
HINTS = ("pass", "pwd", "secret", "token", "credential", "key")

REFERENCE = re.compile(r"[$%]\{|\$\(|\$[A-Za-z_]\w*$|\{\{|<[^>]*>?$|%\w+%$|[A-Za-z_][\w.:>-]*[(\[]")
PATH = re.compile(r"[A-Za-z_]\w*(?:(?:\.|::|->|/)[A-Za-z_]\w*)+$", re.A)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def dictionary(path: str | None = None):
    """Ranks from 1 of words in small letters, as an automaton: WORDS, then the whole words of the tokenizer file at path.

    A whole word is a token of three or more ASCII letters that starts a word. None is the public tokenizer's file.
    """
    import ahocorasick

    with open(path or vocabulary_path(), encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    words = list(WORDS)
    for token in sorted(tokens, key=tokens.get):
        if token[:1] == "\u0120" and len(token) > 3 and token[1:].isascii() and token[1:].isalpha():
            words.append(token[1:].lower())
    automaton = ahocorasick.Automaton()
    for rank, word in enumerate(dict.fromkeys(words), 1):
        automaton.add_word(word, (len(word), rank))
    automaton.make_automaton()
    return automaton


_PLACE = {c: (y, x) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_CUT = math.log10(20)


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _next_to(a: str, b: str) -> bool:
    (ya, xa), (yb, xb) = _PLACE.get(SHIFTED.get(a, a.lower()), (9, 0)), _PLACE.get(SHIFTED.get(b, b.lower()), (-9, 0))
    return a != b and abs(ya - yb) <= 1 and abs(xa - xb) <= 1


def _pieces(value: str, words) -> dict[int, list[tuple[int, float]]]:
    """By end: (start, cost) of the words, dates, repeats, walks and sequences in value."""
    found: dict[int, list[tuple[int, float]]] = {}
    add = lambda i, j, cost: found.setdefault(j, []).append((i, cost))
    n, low = len(value), value.lower() if len(value.lower()) == len(value) else value
    plain = "".join(SUBSTITUTES.get(c, c) for c in low)
    for form, extra in ((low, 0.0), (plain, 1.0)):
        for last, (size, rank) in words.iter(form):
            i, j = last + 1 - size, last + 1
            if extra == 0 or plain[i:j] != low[i:j]:
                capital = 0.0 if value[i:j] == low[i:j] else math.log10(2) if value[i + 1 : j] == low[i + 1 : j] or value[i:j].isupper() else math.log10(2) * (j - i)
                add(i, j, math.log10(rank) + extra + capital)
    at = 0
    while m := _DATE.search(value, at):  # overlapping starts count too
        add(m.start(), m.end(), math.log10(120 if m.end() - m.start() == 4 else 365 * 120))
        at = m.start() + 1
    for period in range(1, 9):  # maximal runs of a repeated block
        i = 0
        while i + period < n:
            j = i
            while j + period < n and value[j] == value[j + period]:
                j += 1
            if j - i >= max(2, period):
                block = sum(map(_alphabet, value[i : i + period]))
                add(i, j + period, block + math.log10(1 + (j - i) / period))
                i = j
            i += 1
    for linked in (_next_to, lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(a) - ord(b) == 1):
        i = 0
        while i < n - 1:
            j = i
            while j + 1 < n and linked(value[j], value[j + 1]):
                j += 1
            if j - i >= 2:
                turns = 0.5 * (j - i) if linked is _next_to else 0
                add(i, j + 1, math.log10(47 * (j - i + 1)) + turns)
            i = max(j, i + 1)
    return found


def guess_cost(value: str, words=None) -> float:
    """Decimal logarithm of the guesses that the cheapest cut of value needs; 0 for the empty value. words: a dictionary."""
    pieces, n = _pieces(value, words or dictionary()), len(value)
    # done[j]: cheapest for value[:j]; open_[j]: the same with a brute-force span that ends at j
    done, open_ = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for j in range(1, n + 1):
        cut = _CUT if j > 1 else 0.0
        open_[j] = min(open_[j - 1], done[j - 1] + cut) + _alphabet(value[j - 1])
        best = open_[j]
        for i, cost in pieces.get(j, ()):
            best = min(best, done[i] + cost + (_CUT if i else 0.0))
        done[j] = best
    return done[n]


def refers(value: str, threshold: float, words) -> bool:
    """True for a value that names where a secret is kept, not the secret."""
    if REFERENCE.match(value):
        return True
    return bool(PATH.match(value)) and all(guess_cost(part, words) < threshold for part in re.split(r"\.|::|->|/", value))


def find_secrets(text: str, threshold: float = SECRET_COST, words=None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, score) in code points, by start and then kind; score: the guess cost of a guess span's value."""
    spans: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        words = words or dictionary()
        spans += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        for m in CONTEXT.finditer(text):
            which = next(g for g in (2, 3, 4) if m[g] is not None)
            value = m[which].rstrip(".,;")
            if m[1] and value.isascii() and value.isalpha() and value.islower() or refers(value, threshold, words):
                continue
            if (cost := guess_cost(value, words)) >= threshold:
                spans.append(("guess", m.start(which), m.start(which) + len(value), cost))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int, float | None]], mark: str = "[SECRET]") -> str:
    """text with every maximal stretch that spans cover replaced by mark."""
    out, at = [], 0
    for _, i, j, _ in spans:
        if j > at:
            if i >= at:
                out += [text[at:i], mark]
            at = j
    return "".join([*out, text[at:]])


SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SECRET_COST, vocabulary: str | None = None) -> DataFrame:
    """key, spans (array of kind, start, end, score) and redacted (the text without them) for every row.

    A null text counts as empty and has no spans; its redacted text stays null. Repeated rows stay repeated; other
    columns are dropped; an empty table gives none. Spans of different kinds may overlap; of one kind they don't,
    and a guess span is a value alone; score is null but for guess spans. vocabulary: path of the dictionary's tokenizer
    file, which every executor reads.
    """

    def body(keys, texts):
        for k, t in zip(keys, texts):
            spans = find_secrets(t or "", threshold, dictionary(vocabulary))
            yield k, [dict(zip(("kind", "start", "end", "score"), s)) for s in spans], t if t is None or not spans else redact(t, spans)

    return map_rows(df.withColumns({"__key": F.col(key), "__text": F.col(text)}), ["__key", "__text"], f"{key} {dict(df.dtypes)[key]}, spans array<{SPAN}>, redacted string", body)


def redact_secrets(df: DataFrame, text: str = "text", threshold: float = SECRET_COST, vocabulary: str | None = None) -> DataFrame:
    """df with its texts' secrets replaced by a mark. Null texts stay null; rows and other columns stay as they are."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        found = ((t, find_secrets(t or "", threshold, dictionary(vocabulary))) for t in texts)
        return pd.Series([redact(t, spans) if spans else t for t, spans in found], dtype=object)

    return df.withColumn(text, clean(F.col(text)))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: numbers of the base's kinds, a digest of their spans, and all spans. Null texts have none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
