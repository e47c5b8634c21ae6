"""SentencePiece BPE encoding by a table of prefixes.

Each prefix of a segment has one last token in the encoding of that prefix.
All tokens that end at a position come from an automaton; the right one is the
one that is compatible with the last token of the prefix before it, where two
tokens are compatible if encoding their joined text gives the two again. The
ids of the whole segment are then read backwards.
"""

from __future__ import annotations

import hashlib
import re
import string
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_texts, remembers

SPACE = "▁"
#: Segments and pairs kept per Python process, and the longest segment that is kept; they bound memory only.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48


class PrefixEncoder:
    """Encoder and decoder for one BPE model with byte fallback.

    The model must not put a space mark behind another character inside a piece, so that texts fall into segments that
    can be encoded one by one; ``ValueError`` otherwise, and for models that are not BPE or change texts beforehand.
    """

    def __init__(self, path: str):
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.vocab_size())
        plain = [i for i in ids if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.rank = {library.id_to_piece(i): (-library.get_score(i), i) for i in plain}
        self.text = {i: p for p, (_, i) in self.rank.items()}
        self.order = {i: (s, i) for s, i in self.rank.values()}
        self.parts: dict[int, tuple[int, int] | None] = dict.fromkeys(self.order)
        self.byte = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.digits = [str(i) for i in ids]
        inner = [p for p in self.rank if SPACE in p.lstrip(SPACE)]
        if inner or any(not library.is_byte(b) for b in self.byte) or library.encode("A Ａ") != self._whole(f"{SPACE}A{SPACE}Ａ"):
            raise ValueError("not a BPE model with byte fallback, plain spaces and unchanged texts")
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        loose = re.escape(self._loose())
        self.pieces_of = re.compile(f"\n|[^{loose}\n]+|[{loose}]+[^{loose}\n]*" if "\n" not in "".join(self.rank) else "(?s).+").findall
        self._automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.tails: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _whole(self, text: str) -> list[int]:
        """Encoding by merging, best pair first; used for single pieces only. Notes the parts of what merges last."""
        parts = list(text)
        final = None
        while len(parts) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            final = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        out: list[int] = []
        for p in parts:
            out.extend([self.rank[p][1]] if p in self.rank else (self.byte[b] for b in p.encode()))
        if len(out) == 1 and final:
            self.parts[out[0]] = tuple(self.rank[p][1] for p in final) if all(p in self.rank for p in final) else None
        return out

    def _loose(self) -> str:
        """Characters before which no piece has another character, but for such characters and the space mark."""
        loose, never = set(string.punctuation), set()
        while True:
            met = {(x, y) for p in self.rank for x, y in zip(p, p[1:]) if y in loose and x not in loose and x != SPACE}
            if not met:
                return "".join(sorted(loose))
            for x, y in met:
                if x.isalnum() or x in never:
                    never.add(y)
                else:
                    loose.add(x)
            loose -= never

    def _automaton(self) -> None:
        """States are prefixes of pieces; each knows the pieces that end in it, longest first, and its steps.

        Pieces that merging cannot reach are in no encoding and are left out.
        """
        pieces = [(p, i) for p, (_, i) in self.rank.items() if self._whole(p) == [i]]
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        own: list[tuple[tuple[int, int], ...]] = [()]
        for piece, i in pieces:
            at = 0
            for c in piece:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    own.append(())
                at = self.step[at][c]
            own[at] = ((len(piece), i),)
        self.fail = [0] * len(self.step)
        self.ends = own[:]
        queue = list(self.step[0].values())
        for at in queue:
            for c, to in self.step[at].items():
                queue.append(to)
                back = self.fail[at]
                while back and c not in self.step[back]:
                    back = self.fail[back]
                self.fail[to] = self.step[back].get(c, 0)
            self.ends[at] = own[at] + self.ends[self.fail[at]]

    def _next(self, at: int, c: str) -> int:
        """Step from a state, by failure arcs where there is none; the states of pieces themselves stay as they are."""
        step, fail = self.step, self.fail
        while at and c not in step[at]:
            at = fail[at]
        return step[at].get(c, 0)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens.

        The merges of both are undone, latest first. What then meets at the border would have merged if that comes before
        the merge just undone; of equal merges the left one comes first.
        """
        part, order, text = self.parts, self.order, self.text
        x, y, limit = a, b, (float("inf"), 0)
        while True:
            joined = self.rank.get(text[x] + text[y])
            if joined is not None and joined < limit:
                return False
            if part[x] and (order[x] > order[y] or not part[y]):
                limit, x = order[x], part[x][1]
            elif part[y]:
                limit, y = (order[y][0], order[y][1] + 1), part[y][0]
            else:
                return True

    def many(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Ids of segments in sorted order; what a segment shares with the one before it is not worked out again."""
        pairs, ends, step, rank = self.pairs, self.ends, self.step, self.rank
        states: list[int] = [0]
        last: list[tuple[int, int] | None] = [None]  # length and id of the last token of each prefix; None: bytes
        out, previous = [], ""
        for segment in segments:
            size = len(segment)
            at = 0
            for a, b in zip(previous, segment):
                if a != b:
                    break
                at += 1
            del states[at + 1 :], last[at + 1 :]
            state = states[at]
            for c in segment[at:] if at else segment:
                at += 1
                to = step[state].get(c)
                state = self._next(state, c) if to is None else to
                found = None
                for value in ends[state]:
                    begin = at - value[0]
                    if not begin:
                        found = value
                        break
                    before = last[begin]
                    if before is None:
                        if segment[begin - 1] not in rank:  # a character outside the vocabulary: nothing merges with it
                            found = value
                            break
                        continue
                    key = (before[1], value[1])
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= REMEMBERED:
                            pairs.clear()
                        fits = pairs[key] = self._compatible(*key)
                    if fits:
                        found = value
                        break
                states.append(state)
                last.append(found)
            ids: list[int] = []
            end = size
            while end:
                token = last[end]
                if token is None:
                    ids.extend(self.byte[b] for b in reversed(segment[end - 1].encode()))
                    end -= 1
                else:
                    ids.append(token[1])
                    end -= token[0]
            ids.reverse()
            out.append(tuple(ids))
            previous = segment
        return out

    def batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts.

        Every segment starts with a space mark, the one that stands before a text included; it is named by what follows.
        """
        parts = []
        for t in texts:
            if not t:
                parts.append([])
            elif "  " in t or SPACE in t or t[0] == " " or t[-1] == " ":
                parts.append([s[1:] for s in self.segments(SPACE + t.replace(" ", SPACE))])
            else:
                parts.append(t.split(" "))
        known, older, tails = self.known, self.older, self.tails
        new = {s for p in parts for s in p if s not in known}
        fresh = {s: older[s] for s in new if s in older}
        cut = {s: self.pieces_of(s) if s and SPACE not in s else [s] for s in new if s not in older}
        heads = sorted({c[0] for c in cut.values() if c[0] not in known and c[0] not in fresh})
        fresh.update(zip(heads, self.many([SPACE + s for s in heads])))
        if len(tails) > REMEMBERED // 8:
            tails.clear()
        ends = sorted({t for c in cut.values() for t in c[1:] if t not in tails})
        tails.update(zip(ends, self.many(ends)))
        for s, (head, *rest) in cut.items():
            if rest:
                fresh[s] = tuple(chain(known[head] if head in known else fresh[head], *[tails[t] for t in rest]))
        keep = {s: i for s, i in fresh.items() if len(s) <= REMEMBERED_CHARS}
        if len(keep) < len(fresh):
            fresh.update((s, known[s]) for p in parts for s in p if s in known)
        else:
            known.update(keep)
            fresh = known
        out = [list(chain.from_iterable([fresh[s] for s in p])) for p in parts]
        if fresh is not known:
            known.update(keep)
        if len(known) > REMEMBERED // 2:
            self.known, self.older = {}, known
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, as the library gives it."""
        return self.library.decode(ids) if ids else ""


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of a model file, one per Python process."""
    remembers("pieces", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256`` per row; without ``ids`` and ``decoded`` on request.

    Whole texts, no begin or end ids. A null text counts as empty: no ids, empty decoded text. Repeated rows and null ids
    stay rows of their own. ``path`` is the model file and must be readable on the executors.
    """

    def make():
        coder = encoder(path)

        def work(texts: list[str]) -> dict[str, list]:
            ids = coder.batch(texts)
            decoded = [coder.decode(i) for i in ids]
            digits = coder.digits.__getitem__
            out = {"n_tokens": [len(i) for i in ids]}
            if with_ids:
                out |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": decoded}
            out["ids_sha256"] = [hashlib.sha256(",".join(map(digits, i)).encode()).hexdigest() for i in ids]
            out["decoded_sha256"] = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
            return out

        return work

    extra = "ids array<int>, decoded string, " if with_ids else ""
    return map_texts(docs, {"doc_id": doc_id}, text, f"n_tokens bigint, {extra}ids_sha256 string, decoded_sha256 string", make)
