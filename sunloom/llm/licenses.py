"""License scans: fuzzy search for short notices.

Texts are compared as their words (ASCII letters lower-cased, every other ASCII character but digits a separator)
joined by single spaces. A notice of n characters may be hit with up to n // EDIT_SHARE edits e: it is cut into e + 1
pieces, of which any hit must hold one unchanged (pigeonhole), so an Aho-Corasick automaton over all pieces finds
every place where a hit can be; only there the regex library's bounded-error matching runs, and reports the span with
the fewest edits. A hit starts and ends with whole words. Words that decide what is licensed (DECIDING, and all that hold
a digit) are matched literally, and a hit may hold no others of them than its notice. Of overlapping hits those with the
fewest edits stay, the longest of them. Phrases of the fixed base list are places where their words stand consecutively,
without edits. Each text is scanned whole, within its row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

EDIT_SHARE = 14
# Phrases of the base contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Usual short notices and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("eclipse public license version 2 0", "epl-2"),
    ("boost software license version 1 0", "bsl-1"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)

# Words on which it depends which license a notice names.
DECIDING = frozenset((
    "mit", "apache", "gnu", "gpl", "lgpl", "agpl", "lesser", "affero", "cc", "by", "nc", "sa", "nd", "zero", "noncommercial", "sharealike", "noderivatives", "noderivs",
    "mozilla", "eclipse", "boost", "not", "no", "without", "all", "some",
))

_BLANKED = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_BLANKED).split()


def _decides(word: str) -> bool:
    return word in DECIDING or any(c.isdigit() for c in word)


def deciding(phrase: str) -> list[str]:
    """The words of phrase that decide, in order."""
    return [w for w in phrase.split() if _decides(w)]


def notice_pattern(phrase: str, edits: int) -> str:
    """A pattern of whole words: runs of words that decide nothing with up to edits errors each, the others literally."""
    runs: list[tuple[bool, list[str]]] = []
    for word in phrase.split():
        if not runs or runs[-1][0] != _decides(word):
            runs.append((_decides(word), []))
        runs[-1][1].append(word)
    parts = [" ".join(words) if literal or not edits else f"(?:{' '.join(words)}){{e<={edits}}}" for literal, words in runs]
    return f"(?b)(?<![^ ]){' '.join(parts)}(?![^ ])"


class Notices:
    """The automaton over the notices' pieces and their bounded-error patterns."""

    def __init__(self, notices: Sequence[tuple[str, str]] = NOTICES, edit_share: int = EDIT_SHARE):
        import ahocorasick
        import regex

        self.seeds, places = ahocorasick.Automaton(), {}
        self.notices = []
        for k, (phrase, label) in enumerate(notices):
            edits = len(phrase) // edit_share
            cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
            for i, j in zip(cuts, cuts[1:]):
                places.setdefault(phrase[i:j], []).append((k, i))
            self.notices.append((phrase, label, edits, regex.compile(notice_pattern(phrase, edits)), deciding(phrase)))
        for piece, where in places.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def match(self, k: int, joined: str, start: int, end: int) -> tuple[int, int, str, int] | None:
        """(start, end, label, edits) of notice k between start and end of joined, if there is a hit."""
        _, label, edits, pattern, words = self.notices[k]
        m = pattern.search(joined, start, end)
        if not m or sum(m.fuzzy_counts) > edits:
            return None
        i, j = m.start() + len(m[0]) - len(m[0].lstrip()), m.end() - len(m[0]) + len(m[0].rstrip())
        return (i, j, label, sum(m.fuzzy_counts)) if deciding(m[0]) == words else None

    def search(self, joined: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) in joined (words between and around single spaces), the best of what overlaps."""
        tried, hits = set(), set()
        for end, (size, where) in self.seeds.iter(joined):
            for k, offset in where:
                start = end + 1 - size - offset
                if (k, start) in tried:
                    continue
                tried.add((k, start))
                phrase, _, edits = self.notices[k][:3]
                if hit := self.match(k, joined, max(0, start - edits), max(0, start + len(phrase) + edits + 1)):
                    hits.add(hit)
        return best_of(hits)


def best_of(hits) -> list[tuple[int, int, str, int]]:
    """Of overlapping hits those with the fewest edits, of these the longest."""
    kept, cluster, reach = [], [], -1
    for hit in sorted(hits):
        if hit[0] >= reach and cluster:
            kept += _fewest(cluster)
            cluster = []
        reach = max(reach, hit[1]) if cluster else hit[1]
        cluster.append(hit)
    return kept + _fewest(cluster)


def _fewest(cluster: list) -> list:
    least = min(((h[3], h[0] - h[1]) for h in cluster), default=None)
    return [h for h in cluster if (h[3], h[0] - h[1]) == least]


def scan_text(text: str, notices: Notices) -> tuple[int, list[dict]]:
    """Number of words, and matches: label, kind (exact or fuzzy), first and last word, span in code points, edits, score."""
    words = words_of(text)
    joined = " " + b" ".join(words).decode("utf-8") + " "
    found = []
    for phrase, label in BASE:
        at = joined.find(f" {phrase} ")
        while at >= 0:
            found.append((at + 1, at + 1 + len(phrase), label, "exact", 0, 1.0))
            at = joined.find(f" {phrase} ", at + 1)
    found += [(i, j, label, "fuzzy", e, max(0.0, 1 - e / max(1, j - i))) for i, j, label, e in notices.search(joined)]
    if not found:
        return len(words), []
    spans = [m.span() for m in _WORD.finditer(text)]
    out, counted, at = [], 0, 0
    for i, j, label, kind, edits, score in sorted(found):
        counted, at = counted + joined.count(" ", at, i), i
        first, last = counted - 1, counted - 1 + joined.count(" ", i, j)
        out.append({"label": label, "kind": kind, "first_word": first, "last_word": last, "start": spans[first][0], "end": spans[last][1], "edits": edits, "score": score})
    return len(words), out


MATCH = "struct<label:string,kind:string,first_word:bigint,last_word:bigint,start:bigint,end:bigint,edits:bigint,score:double>"


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """key, n_words and matches for every row.

    A null text counts as empty: no words, no matches. Repeated rows stay repeated; other columns are dropped; an
    empty table gives none.
    """

    def body(keys, texts, automaton):
        return [(k, *scan_text(t or "", automaton)) for k, t in zip(keys, texts)]

    renamed = df.withColumns({"__key": F.col(key), "__text": F.col(text)})
    return map_rows(renamed, ["__key", "__text"], f"{key} {dict(df.dtypes)[key]}, n_words bigint, matches array<{MATCH}>", body, lambda: Notices(notices))


def license_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of scan_licenses' rows."""
    base = F.filter("matches", lambda m: m["kind"] == "exact")
    starts = F.transform(base, lambda m: m["first_word"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """License labels and places of every document. Null texts are empty, without places."""
    return license_digest(scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
