"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens.  It starts as one state with a loop for each base symbol, and every merge (u, v) adds a gadget:
the state reached by u is copied without its arc v, all arcs u lead to the copy, and every state with
an arc u gets an arc uv to where v led.  What is left are exactly the token sequences that the merges produce,
so each word has one path.  Since all arcs with one label lead to one state, a state is kept as what it takes
away from the state it was copied from; states form a tree, and "has this arc gone on the way from the root" is a
binary search in the tree's pre-order.

A word is encoded by following arcs from its first position, the longest first: the transitions of a state are the arcs by
label less those cut on the way from the root.  As a prefix of a word has one path only, a position from which no arc goes on is
given up for good.  A dense table would have a cell for each pair of the about 49,000 states and labels of the vocabulary used here;
what is kept instead is, by label, the stretches of states that lack it, and the transitions that were looked up.
Decoding emits the labels of the arcs.

Text is treated as the vocabulary file says (NFC, blanks, lower case, the split pattern, bytes as characters, word ends),
special tokens in a text included.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows encode alike; an
empty table gives an empty result; long texts and long words are encoded whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_right

import pandas as pd
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, ready

#: Words whose ids a Python worker remembers, twice as many at most, and arcs that it has looked up: some 30 MB.
CACHE_WORDS = 60_000
CACHE_ARCS = 1 << 16
RESULT = "ids binary, decoded string"

#: Texts of these characters only (Latin letters with accents, common punctuation and currency signs) are split here, by
#: the classes below; any other text is split by the library that defines the file, whose Unicode tables may be newer.
COMMON = re.compile("[\x00-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*").fullmatch
LAST = 0x180
#: The blanks among the common characters, and the split pattern's English endings.
BLANKS = "\t-\r \x85\xa0"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


def _class_of(major: str) -> str:
    """The common characters of a major Unicode category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(LAST) if unicodedata.category(chr(c))[0] == major)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else one from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Automaton:
    """The states and arcs that a vocabulary's merges compile to."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.labels: list[str] = [""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        merged = {u + v for u, v in merges}
        self.made = [-1] * size  # the merge that makes a token
        self.left = [-1] * size
        self.goes: list[int] = [-1] * size  # the state that arcs with this label lead to; -1: no state has such an arc
        for token, i in vocab.items():
            if token not in merged:
                self.goes[i] = 0
        parent, gone, since = [-1], [-1], [-1]
        cut: dict[int, list[int]] = {}  # by token: the states copied without it
        for m, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            q = self.goes[u]
            if q < 0 or self.goes[v] < 0 or not self._before_tour(q, v, parent, gone, since):
                continue
            self.made[uv], self.left[uv], self.goes[uv] = m, u, self.goes[v]
            self.goes[u] = len(parent)
            cut.setdefault(v, []).append(len(parent))
            parent.append(q)
            gone.append(v)
            since.append(m)
        self._tour(parent, since, cut)
        self.index = {t: i for t, i in vocab.items() if self.goes[i] >= 0}
        self.longest = max(map(len, self.index), default=0)
        self.seen: dict[int, bool] = {}

    def _before_tour(self, s: int, t: int, parent: list[int], gone: list[int], since: list[int]) -> bool:
        """Whether state s has an arc t, by walking up to the root."""
        made, left = self.made, self.left
        while s:
            if made[t] >= since[s]:
                t = left[t]
            elif t == gone[s]:
                return False
            else:
                s = parent[s]
        return True

    def _tour(self, parent: list[int], since: list[int], cut: dict[int, list[int]]) -> None:
        """Number the states in pre-order; by token, the stretches of states without it and the merge since when."""
        n = len(parent)
        last = list(range(n))
        kids: list[list[int]] = [[] for _ in range(n)]
        for s in range(1, n):
            kids[parent[s]].append(s)
        number, stack, k = [0] * n, [0], 0
        order = []
        while stack:
            s = stack.pop()
            number[s] = k
            k += 1
            order.append(s)
            stack += kids[s]
        for s in order:
            last[s] = number[s]
        for s in reversed(order[1:]):
            last[parent[s]] = max(last[parent[s]], last[s])
        self.goes = [number[s] if s >= 0 else -1 for s in self.goes]
        self.cuts: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for t, states in cut.items():
            rows = sorted((number[s], last[s], since[s]) for s in states)
            self.cuts[t] = tuple(map(list, zip(*rows)))

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the token may follow in this state: no token it was grown from is cut on the way from the root."""
        bound = sys.maxsize
        made, left, cuts = self.made, self.left, self.cuts
        while token >= 0:
            cut = cuts.get(token)
            if cut is not None:
                at = bisect_right(cut[0], state) - 1
                if at >= 0 and state <= cut[1][at] and cut[2][at] <= bound:
                    return False
            bound = made[token]
            token = left[token]
        return True

    def path(self, word: str, suffix: str) -> list[int]:
        """The tokens of a word of one-character symbols, the last with the suffix."""
        n = len(word)
        ended = word + suffix
        index, goes, longest, arc, seen = self.index, self.goes, self.longest, self.has_arc, self.seen
        # the longest arc first; a position from which no path goes on is never tried again, as a word's
        # first symbols have one path too
        dead: set[int] = set()
        arcs: list[int] = []
        starts: list[int] = []
        at = state = 0
        while at < n:
            for to in range(min(n, at + longest), at, -1):
                t = index.get(word[at:to] if to < n else ended[at:])
                if t is None or to in dead:
                    continue
                if state:
                    key = state << 32 | t
                    ok = seen.get(key)
                    if ok is None:
                        if len(seen) >= CACHE_ARCS:
                            seen.clear()
                        ok = seen[key] = arc(state, t)
                    if not ok:
                        continue
                arcs.append(t)
                starts.append(at)
                at, state = to, goes[t]
                break
            else:
                if not at:
                    raise ValueError(f"no path for {word[:80]!r}")
                dead.add(at)
                arcs.pop()
                at = starts.pop()
                state = goes[arcs[-1]] if arcs else 0
        return arcs


class Tokenizer:
    """A vocabulary file's text treatment around its automaton."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only BPE vocabularies with word ends are supported")
        self.suffix = model["end_of_word_suffix"]
        self.automaton = Automaton(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = dict(enumerate(self.automaton.labels)) | {i: t for t, i in self.special.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters, digits = _class_of("L"), _class_of("N")
        self.split = re.compile(f"{ENDINGS}|[{letters}]+|[{digits}]|[^{BLANKS}{letters}{digits}]+").findall
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # the library's own vocabulary and merges are not needed
        whole = tokenizers.Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": model | {"vocab": {}, "merges": []}}))
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer

    def _ids_of(self, piece: str) -> bytes:
        """The ids of a word written in byte letters."""
        ids = array("I", self.automaton.path(piece, self.suffix))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _ids_of_word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._ids_of(word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8", "replace")]))
        if len(self.known) >= CACHE_WORDS:  # frequent words come back from the generation before
            self.older, self.known = self.known, {}
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    def _plain(self, text: str, out: list[bytes]) -> None:
        if text.isascii() or COMMON(text):
            slow = self._ids_of_word
            for w in self.split(text.lower()):
                ids = self.known.get(w)
                out.append(slow(w) if ids is None else ids)
        else:
            out += [self._ids_of(piece) for piece, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if text:
            if self.special_at is None or not any(s in text for s in self.special):
                self._plain(text, out)
            else:
                for k, part in enumerate(self.special_at.split(text)):
                    if k % 2:
                        out.append(self.special[part].to_bytes(4, "little"))
                    elif part:
                        self._plain(part, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, with a blank between, special tokens included."""
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        labels = self.labels
        return " ".join([labels[i] for i in numbers])


def _tokenizer(content: bytes) -> Tokenizer:
    """The compiled vocabulary, once per Python worker."""
    return ready(("bpe", hash(content)), lambda: Tokenizer(content))


def encode_column(text: Column, content: bytes) -> Column:
    """The ids of a text column, packed."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        t = _tokenizer(content)
        return pd.Series([t.encode(x) for x in texts], dtype=object)

    return ids(text)


def decode_column(ids: Column, content: bytes) -> Column:
    """The text of a column of packed ids (null for null)."""

    @F.pandas_udf("string")
    def text(packed: pd.Series) -> pd.Series:
        t = _tokenizer(content)
        return pd.Series([None if x is None else t.decode(x) for x in packed], dtype=object)

    return text(ids)


def round_trip_column(text: Column, content: bytes) -> Column:
    """Encode, and decode what came out, in one Python step: a struct (ids, decoded)."""

    @F.pandas_udf(RESULT)
    def both(texts: pd.Series) -> pd.DataFrame:
        t = _tokenizer(content)
        ids = [t.encode(x) for x in texts]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([t.decode(x) for x in ids], dtype=object)})

    return both(text)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row; ``vocabulary`` is a file read by the driver."""
    with open(vocabulary, "rb") as f:
        content = f.read()
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", round_trip_column(F.col("text"), content).alias("r"))
    return rows.select("doc_id", n_tokens(F.col("r.ids")).alias("n_tokens"), "r.ids", "r.decoded")
