"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring symbols that occurs inside no vocabulary token can never be joined by a merge, nor can any
merge reach across it. Every such pair in a word is a certain cut: the fragments between cuts are encoded on their
own, looked up in a cache bounded in bytes and dropped when the task ends, and concatenated.

Defined results: a null text encodes like the empty one (no tokens); texts of any length are encoded whole; special
token strings inside a text become their ids, as the tokenizer file says; repeated rows give repeated results, in the
order of the input; no rows give no rows; ids of any type, null or not, are passed on; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Callable

import regex
import tokenizers
from pyspark.sql import DataFrame

from .common import map_rows, only

END = "</w>"
#: Bytes of one generation of a worker's caches, of which there are two: of runs, and of fragments.
RUNS, FRAGMENTS = 32 << 20, 8 << 20
NONE = 1 << 60
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_glyphs() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache
def newer_characters() -> list[str]:
    """Characters that this Python's Unicode tables don't have yet."""
    assigned = regex.compile(r"[\p{L}\p{N}]")
    return [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and assigned.match(c)]


def late_characters(kind: str) -> str:
    """Ranges of the letters (L) or numbers (N) of the regex module that the tokenizers library takes for symbols.

    Libraries follow different Unicode versions; the tokenizers library itself is asked about the newest characters.
    """
    is_kind = regex.compile(rf"\p{{{kind}}}").match
    new = [c for c in newer_characters() if is_kind(c)]
    split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(rf"\p{{{kind}}}"), "removed", invert=True)
    known = {c for c, _ in split.pre_tokenize_str("".join(new))}
    late = [ord(c) for c in new if c not in known]
    there = set(late)
    starts = [k for k in late if k - 1 not in there]
    ends = [k for k in late if k + 1 not in there]
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, ends, strict=True))


def late_lower_case() -> dict[int, str]:
    """Lower case of characters that only the tokenizers library's tables have."""
    lower = tokenizers.normalizers.Lowercase()
    new = [c for c in newer_characters() if regex.match(r"\p{Lu}", c)]
    return {ord(c): low for c in new if (low := lower.normalize_str(c)) != c.lower()}


def piece_pattern(pattern: str) -> str:
    """The file's split pattern with letters and numbers as the tokenizers library knows them."""
    letters, numbers = late_characters("L"), late_characters("N")
    if not letters and not numbers:
        return pattern
    return (
        pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{letters}{numbers}]]")
        .replace(r"|[\p{L}]+", rf"|[\p{{L}}--[{letters}]]+" if letters else r"|[\p{L}]+")
        .replace(r"|[\p{N}]|", rf"|[\p{{N}}--[{numbers}]]|" if numbers else r"|[\p{N}]|")
    )


class Kept(dict):
    """Values by key in two generations of ``limit`` bytes each, about: what is asked for again stays, the rest goes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size, self.older = limit, 0, {}

    def add(self, key, value, size: int):
        if self.size + size > self.limit:
            self.older, self.size = dict(self), 0
            self.clear()
        self[key] = value
        self.size += size
        return value

    def drop(self) -> None:
        self.clear()
        self.older, self.size = {}, 0


class ForcedBoundaryBPE:
    """Encoder and decoder of a tokenizer file whose words end in a suffix symbol (read once a worker)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: left id, right id -> rank of the merge and id of what it makes, in one number
        self.join = {self.ids[a] << 17 | self.ids[b]: k << 17 | self.ids[a + b] for k, (a, b) in enumerate(pairs)}
        glyphs = byte_glyphs()
        self.base = [self.ids[glyphs[b]] for b in range(256)]
        self.last = [self.ids[glyphs[b] + END] for b in range(256)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(piece_pattern(split["pattern"]["Regex"]), regex.V1).findall
        self.late_lower = late_lower_case()
        self.has_late = regex.compile("[" + "".join(map(chr, self.late_lower)) + "]").search if self.late_lower else None
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        #: pairs of neighbouring symbols inside vocabulary tokens; all others force a boundary
        self.inside: set[int] = set()
        for token in self.ids:
            s = [self.ids[x] for x in self.symbols_of(token)]
            self.inside.update(a << 17 | b for a, b in zip(s, s[1:], strict=False))
        self.fragments: dict[tuple[int, ...], tuple[int, ...]] = Kept(FRAGMENTS)
        #: ids of runs without white space, and of the pieces of runs
        self.chunks: dict[str, tuple[int, ...]] = Kept(RUNS)
        #: one number for each id, which what is kept shares, and its digits
        self.own = {i: i for i in self.tokens}
        self.digits = {i: str(i) for i in self.tokens}

    def release(self) -> None:
        """Drops what was kept of the texts so far; the vocabulary stays."""
        self.fragments.drop()
        self.chunks.drop()

    @staticmethod
    def symbols_of(token: str) -> list[str]:
        body = token.removesuffix(END)
        s = list(body)
        if s and body != token:
            s[-1] += END
        return s

    def normalise(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # a final capital sigma is lower-cased like any other: character by character
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text.translate(self.late_lower) if self.late_lower and not text.isascii() and self.has_late(text) else text

    def split_fragments(self, symbols: list[int]) -> list[tuple[int, ...]]:
        inside = self.inside
        cuts = [k for k, (a, b) in enumerate(itertools.pairwise(symbols), 1) if a << 17 | b not in inside]
        if not cuts:
            return [tuple(symbols)]
        return [tuple(symbols[a:b]) for a, b in itertools.pairwise([0, *cuts, len(symbols)])]

    def merge(self, fragment: tuple[int, ...]) -> tuple[int, ...]:
        if len(fragment) == 1:
            return fragment
        kept = self.fragments
        got = kept.get(fragment)
        if got is None:
            got = kept.older.get(fragment)
            if got is None:
                got = self._scan(list(fragment)) if len(fragment) <= 48 else self._heap(list(fragment))
                got = tuple([self.own[i] for i in got])
            if len(fragment) <= 256:
                kept.add(fragment, got, 180 + 8 * (len(fragment) + len(got)))
        return got

    def _scan(self, sym: list[int]) -> tuple[int, ...]:
        """Lowest rank first, leftmost among equals, over a list of the neighbours' ranks: fastest for short fragments."""
        get = self.join.get
        ranks = [get(a << 17 | b, NONE) for a, b in zip(sym, sym[1:], strict=False)]
        while ranks and (low := min(ranks)) < NONE:
            k = ranks.index(low)
            sym[k] = low & 0x1FFFF
            del sym[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(sym[k - 1] << 17 | sym[k], NONE)
            if k < len(ranks):
                ranks[k] = get(sym[k] << 17 | sym[k + 1], NONE)
        return tuple(sym)

    def _heap(self, sym: list[int]) -> tuple[int, ...]:
        """The same by a heap over a linked list: near-linear for very long fragments."""
        join, n = self.join, len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m >> 17, k, sym[k], sym[k + 1], m & 0x1FFFF) for k in range(n - 1) if (m := join.get(sym[k] << 17 | sym[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, merged = heapq.heappop(heap)
            if sym[k] != a or (j := nxt[k]) >= n or sym[j] != b:
                continue
            sym[k], sym[j] = merged, -1
            nxt[k] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = k
            for left, right in ((prv[k], k), (k, nxt[k])):
                if left >= 0 and right < n and (m := join.get(sym[left] << 17 | sym[right])) is not None:
                    heapq.heappush(heap, (m >> 17, left, sym[left], sym[right], m & 0x1FFFF))
        return tuple([s for s in sym if s >= 0])

    def encode_word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        s = [self.base[b] for b in raw]
        s[-1] = self.last[raw[-1]]
        fragments = self.split_fragments(s)
        if len(fragments) == 1:
            return self.merge(fragments[0])
        return tuple([i for f in fragments for i in self.merge(f)])

    def _learn(self, chunk: str) -> tuple[int, ...]:
        """The ids of a run, or of one of its pieces, which is its own only piece."""
        kept = self.chunks
        got = kept.older.get(chunk)
        if got is None:
            # letters alone are one piece, as the pattern has it
            pieces = [chunk] if chunk.isascii() and chunk.isalpha() else self.pieces(chunk)
            if len(pieces) == 1 and pieces[0] == chunk:
                got = self.encode_word(chunk)
            else:
                got = tuple([i for piece in pieces for i in kept.get(piece) or self._learn(piece)])
        if len(chunk) <= 64:
            # two objects and their place in the table, in the sizes that Python gives them
            kept.add(chunk, got, (176 if chunk.isascii() else 200) + len(chunk) * (1 if chunk.isascii() else 4) + 8 * len(got))
        return got

    def parts(self, text: str | None) -> list[tuple[int, ...]]:
        """The ids of each run without white space and each special token."""
        out = []
        for k, segment in enumerate(self.cut_special(text or "")):
            if k % 2:
                out.append((self.special[segment],))
            elif segment:
                segment = self.normalise(segment)
                # str.split takes four control characters for white space that the pattern takes for symbols
                runs = segment.split() if not SEPARATORS.search(segment) else self.pieces(segment)
                get, learn = self.chunks.get, self._learn
                out += [get(run) or learn(run) for run in runs]
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(itertools.chain.from_iterable(self.parts(text)))

    def decode(self, ids) -> str:
        """Tokens joined by a space: these vocabularies come without a decoder. Unknown ids are skipped."""
        return " ".join(filter(None, map(self.tokens.get, ids)))


_loaded: dict[str, ForcedBoundaryBPE] = {}


def tokenizer(path: str) -> ForcedBoundaryBPE:
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


def _worker(path: str, batch: Callable[[ForcedBoundaryBPE, dict], dict]) -> Callable[[dict], dict]:
    """batch(tokenizer, rows) with the worker's tokenizer, whose caches go when the task ends."""
    t = tokenizer(path)

    def run(rows: dict) -> dict:
        return batch(t, rows)

    run.release = t.release
    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the tokens of every whole text. Partitioned as the input is; no shuffle."""

    def batch(t, b):
        return {"doc_id": b["doc_id"], "ids": [t.encode(x) for x in b["text"]]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(only(docs, doc_id=id_col, text=text_col), f"doc_id {kind}, ids array<int>", lambda: _worker(path, batch))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the decoded ids (null ids: empty text)."""

    def batch(t, b):
        return {"doc_id": b["doc_id"], "text": [t.decode(x or ()) for x in b["ids"]]}

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_rows(only(encoded, doc_id=id_col, ids=ids_col), f"doc_id {kind}, text string", lambda: _worker(path, batch))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, and the ids decoded, in one pass."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def batch(t, b):
        out = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in b["text"]:
            ids = t.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha(" ".join(map(t.digits.__getitem__, ids))))
            out["decoded_sha256"].append(sha(t.decode(ids)))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(only(docs, doc_id=id_col, text=text_col), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: _worker(path, batch))
