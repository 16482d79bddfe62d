"""Byte-level BPE by prefix dynamic programming.

A token sequence is the BPE encoding of its bytes exactly if each two
neighbours are the encoding of theirs.  So each prefix of a piece has one valid
last token: the token ending there that is compatible with the last token of
what is left when it is taken off.  Storing that token for every prefix gives

* encoding, by walking back from the end,
* appending: only the new bytes are looked at,
* re-encoding near an edit: prefixes before it stay as they are, and so do those
  after it once as many last tokens as can matter are the old ones,
* the exact token count of every prefix, and with it truncation to a budget.

Pieces are the matches of the split pattern; texts are never cut.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, only, strings, worker_cache

#: Entries of one generation of a worker's caches.
CACHE = 200_000
RANKS = "byte_bpe_50k.tiktoken"
LIMIT = 512
#: The string that byte_bpe_50k.json reads as one special token inside texts.
SPECIAL = "<|endoftext|>"
#: A blank with white space before it and white space or the end after it:
#: only then does the split of a text differ from that of its blank-led chunks.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: White space as the split pattern knows it, and runs of it.
_SPACE, _RUN = regex.compile(r"\s"), regex.compile(r"\s\s+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PieceDP:
    """The last token and the token count of every prefix of one piece; it can grow and be edited.

    The vocabulary must hold every single byte that occurs.
    """

    def __init__(self, codec: "Codec", data: bytes = b"") -> None:
        self.codec, self.data = codec, b""
        self.last: list[int] = [-1]
        self.count: list[int] = [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the stored prefixes don't change."""
        start = len(self.data)
        self.data += more
        last, count, pairs, ok = self.last, self.count, self.codec.pairs, self.codec.compatible
        last += [-1] * len(more)
        count += [0] * len(more)
        at = max(0, start - self.codec.longest)
        for e, (t, n) in self.codec.matches(self.data[at:].decode("latin-1")):  # those that end at e, the longest first
            e += at + 1
            if e <= start or last[e] >= 0:
                continue
            if j := e - n:
                p = last[j]
                if p < 0 or not (v if (v := pairs.get(p << 32 | t)) is not None else ok(p, t)):
                    continue
            last[e] = t
            count[e] = count[j] + 1

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; how many prefixes were computed anew.

        Prefixes up to start stay.  Beyond the new bytes, a prefix depends on the
        last tokens of as many prefixes before it as the longest token has bytes:
        where these are the old ones, and their counts differ from the old ones by
        one number, all that follows is as it was, but for that number.
        """
        shift, reach = len(new) - (end - start), self.codec.longest
        data = self.data[:start] + new + self.data[end:]
        old_last, old_count = self.last, self.count
        self.data, self.last, self.count = data[:start], old_last[: start + 1], old_count[: start + 1]
        at, step, same, by = start, len(new) + reach, 0, None
        while at < len(data):
            stop = min(len(data), at + step)
            self.append(data[at:stop])
            for e in range(max(at, start + len(new) + reach) + 1, stop + 1):  # tokens that end here lie in the old bytes
                d = self.count[e] - old_count[e - shift]
                same = same + 1 if self.last[e] == old_last[e - shift] and d == by else int(self.last[e] == old_last[e - shift])
                by = d
                if same > reach:
                    del self.last[e + 1 :], self.count[e + 1 :]
                    self.data = data
                    self.last += old_last[e - shift + 1 :]
                    self.count += (np.array(old_count[e - shift + 1 :], np.int64) + d).tolist()
                    return stop - start
            at, step = stop, step + reach
        return len(data) - start

    def ids(self, end: int | None = None) -> list[int]:
        i, out = len(self.data) if end is None else end, []
        while i > 0:
            out.append(self.last[i])
            i -= self.codec.size[out[-1]]
        return out[::-1]


class _Cache(dict):
    """What make gives for a key; bounded: when full, the entries become the old ones and those before go."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(key) < 100:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = v
        return v


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split, self.scan = regex.compile(pattern).findall, regex.compile(pattern).finditer
        top = max(ranks.values(), default=-1) + 1
        self.token: list[bytes] = [b""] * top
        for b, i in ranks.items():
            self.token[i] = b
        self.size = [len(b) for b in self.token]
        self.longest = max(self.size, default=1)
        auto = ahocorasick.Automaton()
        for b, i in ranks.items():
            auto.add_word(b.decode("latin-1"), (i, len(b)))
        auto.make_automaton()
        self.matches = auto.iter
        self.pairs: dict[int, bool] = {}
        self.piece = _Cache(self._piece)
        self.ids_of = _Cache(self._chunk)
        self.prefixes = _Cache(self._prefixes)

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain BPE, for the few bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of the bytes of a and b."""
        key = a << 32 | b
        v = self.pairs.get(key)
        if v is None:
            if len(self.pairs) >= 2 * CACHE:
                self.pairs.clear()
            v = self.pairs[key] = self._merge(self.token[a] + self.token[b]) == [self.token[a], self.token[b]]
        return v

    def encode_slow(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece.__getitem__, self.split(text))))

    def _piece(self, piece: str) -> tuple[int, ...]:
        """As PieceDP.ids(), without the counts."""
        data = piece.encode()
        t = self.ranks.get(data)
        if t is not None:
            return (t,)
        last, pairs, get = [-1] * (len(data) + 1), self.pairs, self.pairs.get
        for e, (t, n) in self.matches(data.decode("latin-1")):
            e += 1
            if last[e] < 0:
                j = e - n
                if j == 0:
                    last[e] = t
                elif (p := last[j]) >= 0:
                    v = get(p << 32 | t)
                    if v or v is None and self.compatible(p, t):
                        last[e] = t
        i, out, size = len(data), [], self.size
        while i:
            t = last[i]
            out.append(t)
            i -= size[t]
        return tuple(out[::-1])

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):  # letters are one piece
            return self.piece[chunk]
        return tuple(self.encode_slow(chunk))

    def piece_counts(self, data: bytes) -> list[int]:
        """The token count of every byte prefix of a piece: one more than at the place where its last token starts."""
        last, count, pairs, get = [-1] * (len(data) + 1), [0] * (len(data) + 1), self.pairs, self.pairs.get
        for e, (t, n) in self.matches(data.decode("latin-1")):
            e += 1
            if last[e] < 0:
                j = e - n
                if j == 0:
                    last[e], count[e] = t, 1
                elif (p := last[j]) >= 0:
                    v = get(p << 32 | t)
                    if v or v is None and self.compatible(p, t):
                        last[e], count[e] = t, count[j] + 1
        return count

    def _prefixes(self, chunk: str) -> bytes | list[int]:
        """The token count of every byte prefix of a chunk as a text of its own; the last one is the chunk's.

        A prefix may be split otherwise than the whole: white space at its end is one
        piece, and the first two characters of three of the contractions are two.
        """
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            count = self.piece_counts(chunk.encode())
        else:
            count = [0]
            for piece in self.split(chunk):
                own, base = self.piece_counts(piece.encode()), count[-1]
                if piece in ("'re", "'ve", "'ll"):
                    own[2] = 2
                count += [base + n for n in own[1:]]
            for m in _RUN.finditer(chunk):
                i, run = len(chunk[: m.start()].encode()), m[0].encode()
                count[i + 1 : i + len(run) + 1] = [count[i] + n for n in self.piece_counts(run)[1:]]
        return bytes(count) if max(count) < 256 else count

    @staticmethod
    def chunks(text: str) -> list[str] | None:
        """The text cut before each blank, or None where the split pattern sees more than one such chunk."""
        if not text or _UNSAFE.search(text):
            return None
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, text: str) -> list[int]:
        c = self.chunks(text)
        return self.encode_slow(text) if c is None else list(chain.from_iterable(map(self.ids_of.__getitem__, c)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def counts(self, text: str) -> tuple[list[str], np.ndarray]:
        """Chunks of the text that no piece crosses, and the token count of each, which is that of its last prefix."""
        c = self.chunks(text)
        if c is None:
            c = self.split(text)
        return c, np.array([x[-1] for x in map(self.prefixes.__getitem__, c)], np.int64)


class PrefixCounts:
    """Exact token counts of the prefixes of a text: count(p) and cut(budget), from stored counts, without encoding.

    A prefix is counted as the text that it is.  Its count is that of the chunks
    before, and the stored one of its part of the last chunk; only white space
    at its end that began in an earlier chunk is one piece of its own.
    """

    def __init__(self, codec: Codec, text: str, counted: tuple[list[str], np.ndarray] | None = None) -> None:
        self.codec, self.text = codec, text
        self.chunks, n = counted or codec.counts(text)
        self.ends = np.cumsum([len(c) for c in self.chunks], dtype=np.int64)
        self.total = np.cumsum(n)

    def _run(self, chars: int) -> int:
        """Where the white space at the end of text[:chars] starts."""
        while chars and _SPACE.match(self.text, chars - 1):
            chars -= 1
        return chars

    def _within(self, k: int, chars: int) -> int:
        """Tokens of text[:chars], which ends in chunk k, if no white space at its end began before that."""
        start = int(self.ends[k - 1]) if k else 0
        part = self.chunks[k][: chars - start]
        return (int(self.total[k - 1]) if k else 0) + self.codec.prefixes[self.chunks[k]][len(part) if part.isascii() else len(part.encode())]

    def count(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        if chars <= 0:
            return 0
        k = int(np.searchsorted(self.ends, chars, "left"))
        start = self._run(chars)
        if start < chars and start < (int(self.ends[k - 1]) if k else 0):
            return (self.count(start) if start else 0) + self.codec.piece_counts(self.text[start:chars].encode())[-1]
        return self._within(k, chars)

    def cut(self, budget: int) -> int:
        """Characters of the longest prefix with at most budget tokens.

        It ends in the last chunk that begins below the budget, or in white space
        that goes on from there.  Counts don't rise with every character, so the
        places there are tried from the last one back.
        """
        k = int(np.searchsorted(np.r_[0, self.total[:-1]], budget - 1, "right")) - 1 if len(self.total) else -1
        if k < 0 or budget <= 0:
            return 0
        start, end = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        run = self._run(end)
        if run < end:  # what goes on from here is one run of white space
            stop = end
            while stop < len(self.text) and _SPACE.match(self.text, stop):
                stop += 1
            if stop > end:
                base, own = self.count(run), self.codec.piece_counts(self.text[run:stop].encode())
                size = len(self.text[run:stop].encode())
                for i in range(stop, end, -1):
                    if base + own[size] <= budget:
                        return i
                    size -= len(self.text[i - 1].encode())
        lead = start  # white space that goes on from before is counted with it
        while lead < end and _SPACE.match(self.text, lead):
            lead += 1
        own, size, base = self.codec.prefixes[self.chunks[k]], len(self.chunks[k].encode()), int(self.total[k - 1]) if k else 0
        for i in range(end, lead, -1):
            if base + own[size] <= budget:
                return i
            size -= len(self.text[i - 1].encode())
        return next((i for i in range(lead, start, -1) if self.count(i) <= budget), start)


class TextTokens:
    """The pieces of a text with their tokens; appends and edits look only at the pieces around them."""

    def __init__(self, codec: Codec, text: str = "") -> None:
        self.codec, self.text, self.pieces = codec, text, codec.split(text)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.codec.piece.__getitem__, self.pieces)))

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the characters from start to end; how many pieces were split anew.

        A match depends on two characters after it at most, or on where white
        space ends, and never on what is before it.  So splitting starts a few
        pieces before the edit and ends at the first old boundary after it.
        """
        ends = np.cumsum([len(p) for p in self.pieces], dtype=np.int64)
        k = max(0, int(np.searchsorted(ends, start, "left")) - 2)
        while k and _SPACE.match(self.pieces[k]) and _SPACE.match(self.pieces[k - 1], len(self.pieces[k - 1]) - 1):
            k -= 1
        at, shift = int(ends[k - 1]) if k else 0, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        got: list[str] = []
        for m in self.codec.scan(self.text, at):
            got.append(m[0])
            if m.end() >= start + len(new):
                i = int(np.searchsorted(ends, m.end() - shift))
                if i < len(ends) and ends[i] == m.end() - shift:
                    self.pieces[k : i + 1] = got
                    return len(got)
        self.pieces[k:] = got
        return len(got)


def codec(path: str, pattern: str) -> Codec:
    cache = worker_cache()
    if (key := ("codec", path, pattern)) not in cache:
        cache[key] = Codec(load_ranks(path), pattern)
    return cache[key]


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the tokens of every whole text, without special tokens.

    A null or empty text has no tokens.  doc_id may be null or repeated: one row
    out for each row in.  Other columns are not looked at.
    """
    path, pat = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        for b in batches:
            ids, ends = [], [0]
            for t in strings(b.column(1)):
                ids.append(np.array(c.encode(t), np.int32))
                ends.append(ends[-1] + len(ids[-1]))
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))], ["doc_id", "ids"])

    return arrow_map(only(docs, doc_id="long", text="string"), run, "doc_id long, ids array<int>", "codec")


def decode_documents(tokens: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """tokens with their bytes: doc_id, ids, decoded binary.  Null or empty ids give no bytes."""
    path, pat = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        for b in batches:
            lists = b.column(1)
            ends, values = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False)
            out = [c.decode(values[i:j].tolist()) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return arrow_map(tokens.select(F.col("doc_id").cast("long"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids")), run, "doc_id long, ids array<int>, decoded binary", "codec")


def round_trip_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, decoded binary of every row of docs: encode_documents and decode_documents with one codec in a task instead of two."""
    path, pat = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        for b in batches:
            ids = [c.encode(t) for t in strings(b.column(1))]
            decoded = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return arrow_map(only(docs, doc_id="long", text="string"), run, "doc_id long, ids array<int>, decoded binary", "codec")


def token_counts(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, limit: int = LIMIT, special: str | None = SPECIAL) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_bytes of every whole text, from stored prefix counts.

    special: a string that counts as one token wherever it stands (None: no
    such string).  cut_bytes: the UTF-8 bytes of the longest prefix (in whole
    characters) that as a text of its own has at most limit tokens.  A null text is empty: 0 bytes,
    0 tokens.  One row out for each row in.
    """
    path, pat = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def of(c: Codec, text: str) -> tuple[int, int, int]:
        size = len(text) if text.isascii() else len(text.encode())
        parts = text.split(special) if special and special in text else [text]
        found = [c.counts(p) for p in parts]
        each = [int(n.sum()) for _, n in found]
        total = sum(each) + len(parts) - 1
        if total <= limit:
            return size, total, size
        left, done = limit, 0
        for k, part in enumerate(parts[:-1]):
            if each[k] + 1 > left:  # it ends in this part, or within the string after it
                tail = part + special[:-1]
                return size, total, done + len(tail[: PrefixCounts(c, tail).cut(left)].encode())
            left -= each[k] + 1
            done += len(part.encode()) + len(special.encode())
        return size, total, done + len(parts[-1][: PrefixCounts(c, parts[-1], found[-1]).cut(left)].encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        for b in batches:
            rows = np.array([of(c, t) for t in strings(b.column(1))], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 1] > limit), pa.array(rows[:, 2])], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    return arrow_map(only(docs, doc_id="long", text="string"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long", "codec")
