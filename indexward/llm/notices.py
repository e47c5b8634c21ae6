"""License scans: phrases, and a fuzzy search for short notices.

A notice is cut into two more pieces than the edits allowed, so at least two of
its pieces stand unchanged, and at about the right distance, wherever it occurs.
Exact occurrences of pieces give windows of bounded length; the regex library's
bounded-error matching decides in them. The words that name a license have to
stand exactly; edits are allowed elsewhere in the notice.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

# The phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Kinds of Creative Commons licenses: the part of the name in words, and the code.
_CREATIVE_COMMONS = {
    "attribution": "by", "attribution sharealike": "by sa", "attribution share alike": "by sa", "attribution noderivatives": "by nd",
    "attribution noderivs": "by nd", "attribution noncommercial": "by nc", "attribution non commercial": "by nc",
    "attribution noncommercial sharealike": "by nc sa", "attribution noncommercial noderivatives": "by nc nd",
    "attribution noncommercial noderivs": "by nc nd",
}

#: Names of licenses as they stand in "under the terms of the ...", and their labels.
_NAMES = {
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl", "gnu free documentation license": "gfdl", "apache license": "apache",
    "mit license": "mit", "isc license": "isc", "bsd license": "bsd", "bsd 2 clause license": "bsd", "bsd 3 clause license": "bsd",
    "mozilla public license": "mpl", "eclipse public license": "epl", "european union public licence": "eupl",
    "boost software license": "bsl", "artistic license": "artistic", "zlib license": "zlib", "sil open font license": "ofl",
    "python software foundation license": "psf", "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl", "open database license": "odbl", "do what the fuck you want to public license": "wtfpl",
}

#: Short notices as normalised words, and their labels. Words in braces name the license and must stand exactly.
NOTICES = {
    **{f"under the terms of the {{{name}}}": label for name, label in _NAMES.items()},
    **{f"{verb} under the {{{name}}}": label for verb in ("licensed", "released", "distributed") for name, label in _NAMES.items()},
    **{f"licensed under {{cc {code}}} {version}": "cc-" + code.replace(" ", "-") for code in sorted(set(_CREATIVE_COMMONS.values())) for version in ("4 0", "3 0")},
    **{f"licensed under a {{creative commons {name}}}": "cc-" + code.replace(" ", "-") for name, code in _CREATIVE_COMMONS.items()},
    **{f"licensed under the {{creative commons {name}}}": "cc-" + code.replace(" ", "-") for name, code in _CREATIVE_COMMONS.items()},
    "licensed under the {gpl}": "gpl",
    "licensed under the {lgpl}": "lgpl",
    "licensed under the {agpl}": "agpl",
    "{cc0} 1 0 universal public domain dedication": "cc0",
    "dedicated to the {public domain} by waiving all rights": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission is hereby granted free of charge to any person or organization obtaining a copy": "bsl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd",
    "this source code form is subject to the terms of the {mozilla public license}": "mpl",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: Score of a phrase that stands in no notice.
MENTION = 0.5

_SEPARATORS = bytes(b if (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))


def normalised(text: str) -> tuple[str, int]:
    """The words (A-Z lower-cased, cut at other ASCII characters) with one space before and after each, and their number."""
    words = text.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()
    return (" " + b" ".join(words).decode("utf-8", "replace") + " " if words else ""), len(words)


def word_numbers(norm: str, places: list[int]) -> list[int]:
    """The numbers of the words that begin at (or contain) ascending places of normalised text, in one pass."""
    out, at, n = [], 0, 0
    for place in places:
        n += norm.count(" ", at, place)
        at = place
        out.append(n)
    return out


def phrase_places(norm: str, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """First word and label of every place where the words of a phrase stand."""
    found = []
    for phrase, label in phrases.items():
        needle, places = f" {phrase} ", []
        at = norm.find(needle)
        while at >= 0:
            places.append(at)
            at = norm.find(needle, at + 1)
        found += [(n, label) for n in word_numbers(norm, places)]
    return found


@dataclass(frozen=True)
class Match:
    """A fuzzy notice: label, position in the normalised words, edits, length of the notice."""

    label: str
    start: int
    end: int
    edits: int
    length: int


class NoticeSearch:
    """Finds notices with at most ``rate`` edits per character, none of them in words that name a license."""

    #: Windows that overlap are searched together up to so many times the length of the notice.
    TOGETHER = 4

    def __init__(self, notices: dict[str, str], rate: float = 0.06):
        self.seeds = ahocorasick.Automaton()
        self.notices = []
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for n, (marked, label) in enumerate(notices.items()):
            notice = f" {marked.replace('{', '').replace('}', '')} "
            size, k = len(notice), int(len(notice) * rate)
            bounds = [size * i // (k + 2) for i in range(k + 3)]
            for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                pieces.setdefault(notice[a:b], []).append((n, piece, a))
            parts = regex.split(r"[{}]", marked)  # every second part names the license
            fuzzy = [f" {p.strip()} " if p.strip() else " " for p in parts]
            # The spaces around a name belong to it, so that only whole words count; other parts may have edits.
            pattern = "".join(
                regex.escape(f" {p} ") if i % 2 else f"(?:{regex.escape(q.strip())}){{e<={k}}}" if q.strip() else "" for i, (p, q) in enumerate(zip(parts, fuzzy))
            )
            begin = "" if pattern.startswith(regex.escape(" ")) else "(?<= )"
            end = "" if len(parts) > 1 and not parts[-1].strip() else "(?= )"
            self.notices.append((label, size, k, regex.compile(f"(?e){begin}{pattern}{end}")))
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def windows(self, norm: str) -> dict[int, list[list[int]]]:
        """Per notice the stretches in which two different pieces stand at about the distance they have in the notice."""
        begins: dict[int, list[tuple[int, int]]] = {}
        for stop, (length, uses) in self.seeds.iter(norm):
            for n, piece, offset in uses:
                begins.setdefault(n, []).append((stop + 1 - length - offset, piece))
        out: dict[int, list[list[int]]] = {}
        for n, hits in begins.items():
            _, size, k, _ = self.notices[n]
            hits.sort()
            mine: list[list[int]] = []
            first = 0
            seen: dict[int, int] = {}  # pieces among the hits of at most k characters before
            for begin, piece in hits:
                while hits[first][0] < begin - 2 * k:
                    old = hits[first][1]
                    seen[old] -= 1
                    if not seen[old]:
                        del seen[old]
                    first += 1
                seen[piece] = seen.get(piece, 0) + 1
                if len(seen) < 2 and k + 2 > 1:
                    continue
                a, b = max(0, hits[first][0] - k), begin + size + 2 * k
                if mine and a <= mine[-1][1] and b - mine[-1][0] <= self.TOGETHER * size:
                    mine[-1][1] = max(mine[-1][1], b)
                elif not mine or b > mine[-1][1]:
                    mine.append([a, b])
            if mine:
                out[n] = mine
        return out

    def find(self, norm: str) -> list[Match]:
        """All notices in normalised text, by place."""
        out = set()
        for n, stretches in self.windows(norm).items():
            label, size, k, pattern = self.notices[n]
            for a, b in stretches:
                for m in pattern.finditer(norm, a, min(b, len(norm))):
                    if (edits := sum(m.fuzzy_counts)) <= k:
                        out.add(Match(label, m.start(), m.end(), edits, size - 2))
        return sorted(out, key=lambda m: (m.start, m.label, m.edits, m.end))


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None, rate: float = 0.06,
) -> DataFrame:
    """Per row ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    The base columns come from the phrases; ``labels`` joins theirs with those of the notices, ``spans`` lists the notices
    as ``label:first word:edits``. The score is the share of unchanged characters of the best notice; a phrase without a notice
    is a mention and scores ``MENTION``, a text without either 0. Null and empty texts have no words, empty labels, null places
    and the score 0. Repeated rows stay.
    """
    phrases, notices = dict(PHRASES if phrases is None else phrases), dict(NOTICES if notices is None else notices)

    def make():
        search = NoticeSearch(notices, rate)

        def work(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for t in texts:
                norm, n = normalised(t)
                base = phrase_places(norm, phrases)
                found = search.find(norm)
                labels = {label for _, label in base}
                values = (
                    n, len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None),
                    ",".join(sorted(labels)), ",".join(sorted(labels | {m.label for m in found})),
                    max([MENTION if base else 0.0, *(1 - m.edits / m.length for m in found)]),
                    ",".join(f"{m.label}:{w}:{m.edits}" for m, w in zip(found, word_numbers(norm, [m.start for m in found]))),
                )
                for k, v in zip(out, values):
                    out[k].append(v)
            return out | {k: pa.array(out[k], pa.int64()) for k in ("first_word", "last_word")}

        return work

    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"
    return map_texts(docs, {"doc_id": doc_id}, text, schema, make)
