"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch go into a trie of units (byte-level characters, the
last one of a word marked as its end).  A depth-first walk gives each node its
last-token state: the last token of the encoding of the prefix that the node
stands for.  It is the one token that is a suffix of the prefix and that stays
apart, under the merges, from the last token of what precedes it; an automaton of the
vocabulary, stepped along with the walk, names the tokens that are suffixes.
Ancestors' states are on the path, so a prefix that words share is computed once; a
word's tokens are read off its path backwards.

Every text is cut at `[\\x20\\x09-\\x0D]`, where neither the normaliser nor the
pre-tokenizer can join anything, and each distinct piece is encoded once.  No row
is shuffled.  Memory is bounded: the tables of pieces and words, which a worker keeps
for its next tasks, start afresh at `most_pieces` and at `MOST_BYTES`; a word or piece
of more than `LONG` characters is not kept, and such a word is walked on its own, without
a trie.

Defined cases: a null or empty text has no tokens and decodes to an empty text;
special tokens written in a text become their ids, as in the library; a very long text is
one row, whose ids a task holds; an id may be null or of any type and is passed through;
other columns are ignored, whatever their names; repeated rows repeat; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Added to a word's last unit; byte-level characters are all below it.
_END = 0x1000
#: Characters of a long word, and bytes of pieces that a worker keeps.
LONG, MOST_BYTES = 1024, 32 << 20


#: The pre-tokenizer's pattern, as the file has it, and the same for lower-case ASCII.
_PATTERN = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class TrieBPE:
    """An encoder for a tokenizer file of kind BPE with an end-of-word suffix."""

    def __init__(self, path: str, most_pairs: int = 400_000):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tool = Tokenizer.from_file(path)  # of it only the normaliser and the pre-tokenizer are used
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.vocab, **self.added}.items()}
        self.simple = _PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False)
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        made = {a + b for a, b in merges}
        # Ranks: units first, then merged tokens in the order of their merges.
        self.rank = {self._inner(t): i for i, t in enumerate(t for t in self.vocab if t not in made)}
        units = len(self.rank)
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(units)]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            t, x, y = self._inner(a + b), self.rank[self._inner(a)], self.rank[self._inner(b)]
            self.pair[x, y] = self.rank[t] = len(self.halves)
            self.halves.append((x, y))
        self.ids = [0] * len(self.halves)
        self.size = [0] * len(self.halves)
        for t, r in self.rank.items():
            outer = t[:-1] + chr(ord(t[-1]) - _END) + self.suffix if ord(t[-1]) >= _END else t
            self.ids[r], self.size[r] = self.vocab[outer], len(t)
        self.apart: dict[int, bool] = {}
        self.most_pairs = most_pairs
        self._automaton()
        self.known: dict[str, list[int]] = {}

    def _automaton(self):
        """Of all tokens: children and failure links; `ends` has the tokens that are
        suffixes of a state, longest first."""
        down, ends, token = [{}], [()], [None]
        for t, r in self.rank.items():
            at = 0
            for c in t:
                nxt = down[at].get(c)
                if nxt is None:
                    nxt = down[at][c] = len(down)
                    down.append({})
                    token.append(None)
                at = nxt
            token[at] = (r, len(t))
        fail = [0] * len(down)
        ends = [()] * len(down)
        queue = list(down[0].values())
        for at in queue:  # by depth
            ends[at] = ((token[at],) if token[at] else ()) + ends[fail[at]]
            for c, nxt in down[at].items():
                f = fail[at]
                while f and c not in down[f]:
                    f = fail[f]
                fail[nxt] = down[f].get(c, 0)
                queue.append(nxt)
        self.down, self.fail, self.ends = down, fail, ends
        self.goto: list[dict[str, int]] = [{} for _ in down]  # steps taken before

    def _inner(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + _END)
        return token

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether no merge, in order of rank, crosses the border between tokens a
        and b: both are taken apart again, latest merge first."""
        known = self.apart.get(a << 20 | b)
        if known is None:
            if len(self.apart) >= self.most_pairs:
                self.apart.clear()
            known = self.apart[a << 20 | b] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        limit, pair, halves = 1 << 60, self.pair, self.halves
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            left = a > b
            for _ in range(2):
                if left:
                    limit, part = a, halves[a][1]
                    if part != a:
                        a = part
                        break
                else:
                    limit, part = b + 1, halves[b][0]
                    if part != b:
                        b = part
                        break
                left = not left
            else:
                return True

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Byte-level words to their token ids."""
        root: dict = {}
        for w in words:
            if len(w) > LONG:
                continue
            node = root
            for c in w[:-1]:
                nxt = node.get(c)
                if nxt is None:
                    nxt = node[c] = {}
                node = nxt
            # A word's end is a unit of its own kind: a leaf.
            node[chr(ord(w[-1]) + _END) if self.suffix else w[-1] + "\0"] = w
        down, fail, goto, ends, apart, ids, size = self.down, self.fail, self.goto, self.ends, self.apart, self.ids, self.size
        out = {w: self._long(w) for w in words if len(w) > LONG}
        last = [-1]  # of the prefixes on the path
        stack = [(1, c, node, 0) for c, node in root.items()]
        while stack:
            depth, unit, node, state = stack.pop()
            step = goto[state].get(unit)
            if step is None:
                step, c = state, unit[0]
                while step and c not in down[step]:
                    step = fail[step]
                step = goto[state][unit] = down[step].get(c, 0)
            state = step
            for t, n in ends[state]:
                if n == depth:
                    break
                before = last[depth - n]
                ok = apart.get(before << 20 | t)
                if ok if ok is not None else self.stays_apart(before, t):
                    break
            else:
                raise ValueError(f"no token ends a prefix of {node!r}")
            del last[depth:]
            last.append(t)
            if isinstance(node, str):
                got, at = [], depth
                while at:
                    t = last[at]
                    got.append(ids[t])
                    at -= size[t]
                got.reverse()
                out[node] = got
            else:
                depth += 1
                stack += [(depth, c, child, state) for c, child in node.items()]
        return out

    def _long(self, word: str) -> list[int]:
        """The same walk along one word, whose prefixes no other word shares."""
        last, state, n = [-1], 0, len(word)
        for depth, c in enumerate(word, 1):
            unit = c if depth < n else chr(ord(c) + _END) if self.suffix else c
            while state and unit not in self.down[state]:
                state = self.fail[state]
            state = self.down[state].get(unit, 0)
            t = next((t for t, size in self.ends[state] if size == depth or self.stays_apart(last[depth - size], t)), None)
            if t is None:
                raise ValueError(f"no token ends a prefix of {word[:20]!r}")
            last.append(t)
        got = []
        while n:
            got.append(self.ids[last[n]])
            n -= self.size[last[n]]
        return got[::-1]

    def words(self, piece: str) -> list[str]:
        """Byte-level words of a piece without special tokens."""
        if piece.isascii():
            piece = piece.lower()
            if piece.isalpha():
                return [piece]
            if piece.isprintable() and self.simple:  # what these characters stand for in a byte-level vocabulary
                return _ASCII.findall(piece)
        else:
            piece = self.tool.normalizer.normalize_str(piece)
        return [w for w, _ in self.tool.pre_tokenizer.pre_tokenize_str(piece)]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        plan: list[list] = []
        for p in pieces:
            if self.split_added and "<" in p and self.split_added.search(p):
                plan.append([self.added[x] if x in self.added else w for x in self.split_added.split(p) if x for w in ([x] if x in self.added else self.words(x))])
            else:
                plan.append(self.words(p))
        known = self.known
        known |= self.encode_words([w for w in {w for ws in plan for w in ws} if isinstance(w, str) and w not in known])
        return [known[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else [i for w in ws for i in ([w] if isinstance(w, int) else known[w])] for ws in plan]

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without a decoder: the tokens, joined by one space."""
        return " ".join([self.names[i] for i in ids])


class _Cache:
    """An encoder with the pieces that it has met, one for a worker process."""

    of: dict[str, _Cache] = {}

    def __init__(self, path: str):
        self.bpe = TrieBPE(path)
        self.clear()

    def clear(self):
        self.of_piece: dict[bytes, tuple[int, str, str]] = {}
        self.size = 0
        self.bpe.known.clear()


def _cache(path: str) -> _Cache:
    if path not in _Cache.of:
        _Cache.of[path] = _Cache(path)
    return _Cache.of[path]


def digests(texts: list[bytes], path: str, most_pieces: int) -> list[tuple[int, str, str]]:
    """(tokens, SHA-256 of the ids, SHA-256 of the decoded text) of each text."""
    cache, rows = _cache(path), []
    bpe = cache.bpe
    for i, j in C.blocks(texts, 4 << 20):
        split = [t.split() for t in texts[i:j]]
        if len(cache.of_piece) >= most_pieces or cache.size >= MOST_BYTES:
            cache.clear()
        if len(bpe.known) >= most_pieces:
            bpe.known.clear()
        known, names = cache.of_piece, bpe.names
        new = [p for p in set().union(*split) if p not in known]
        for p, ids in zip(new, bpe.encode_pieces([p.decode("utf-8") for p in new]), strict=True):
            known[p] = (len(ids), " ".join(map(str, ids)), " ".join([names[i] for i in ids]))
        cache.size += sum(map(len, new))
        for s in split:
            got = [x for p in s if (x := known[p])[0]]  # a piece may have no tokens
            n, ids, text = zip(*got, strict=True) if got else ((), (), ())
            rows.append((sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(text).encode()).hexdigest()))
        if max(map(len, new), default=0) > LONG:
            for kept in (known, bpe.known):
                for x in [x for x in kept if len(x) > LONG]:
                    del kept[x]
    return rows


def _run(path: str, most_pieces: int):
    def run(batches):
        for b in batches:
            rows = C.without_gc(digests)(C.text_bytes(b.column(1)), path, most_pieces)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[c] for r in rows], pa.string()) for c in (1, 2)]], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_pieces: int = 450_000) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256."""
    C.ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("x"))
    out = x.mapInArrow(_run(path, most_pieces), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids: the tokens themselves."""
    C.ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        bpe = _cache(path).bpe
        for b in batches:
            split = [t.split() for t in C.text_bytes(b.column(1))]
            pieces = list({p for s in split for p in s})
            known = dict(zip(pieces, bpe.encode_pieces([p.decode("utf-8") for p in pieces]), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[i for p in s for i in known[p]] for s in split], pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("x")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
