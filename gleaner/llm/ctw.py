"""LM scoring by context-tree weighting over bytes.

A text is its bytes with A to Z lower-cased, and an end (0xFF, which UTF-8 never
holds).  Each byte is eight binary decisions, high bit first; a node is a context of
0 to DEPTH bytes before it and the bits decided so far.  A node counts the zeros
and ones that training texts have there; its Krichevsky-Trofimov estimate is
mixed with what its longer contexts say, half and half beforehand:
P = (KT + product of the P of its children) / 2, and P = KT at full depth.  After
training, a node answers for itself with the weight KT / 2P, and leaves the rest to
the longer context.  A context that training hasn't seen adds nothing: the
longest seen one answers for itself.

The corpus is gathered as counts of byte strings of DEPTH + 1: those of all
documents, counted over the training ones, so that every string that has to be
scored is in the tree.  The tree is weighted in strata of two bytes: a group
of a stratum (the strings that end in one context) has 65,536 contexts at most.
What is stored is the log probability of each such string's last byte, and a
text's score is the sum over its places.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, forget, only, stage, strings, worker_cache

#: Bytes of context.
DEPTH = 5
END = 0xFF
#: The context at which the lower stratum begins, and the one at which the upper one does; the driver weights what is above (65,280 nodes at most).
LOWER, UPPER = 3, 1
#: Of crc32(doc_id as text): the remainder of held-out rows.
FOLDS, HELD = 7, 2
#: Strings of a model that goes to the executors whole (16 bytes each), and of a part of a larger one, which goes there part by part.
SENT, PART = 4_000_000, 2_000_000
#: Bytes that are worked on at once, distinct strings that a task gathers before it passes them on, rows of a stratum worked on at once (a group stays whole).
BYTES, GATHERED, ROWS = 2 << 20, 3 << 20, 200_000
#: Bytes of text whose words are told apart together.
WORD_BYTES = 8 << 20
_PAD = bytes([END]) * DEPTH
_LN2, _LN10 = np.log(2), np.log(10)


# Byte strings as numbers.  The bytes of the context come first, the nearest one in
# the highest place, and the byte itself last: so strings sort by ever longer contexts.


def byte_strings(buf: np.ndarray) -> np.ndarray:
    """The number of the DEPTH + 1 bytes that end at each place from DEPTH on."""
    n = len(buf) - DEPTH
    out = buf[DEPTH:].astype(np.int64)
    for back in range(1, DEPTH + 1):
        out |= buf[DEPTH - back : DEPTH - back + n].astype(np.int64) << (8 * (DEPTH - back + 1))
    return out


def windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(strings, the place in texts of the text that each is of), in blocks of about BYTES; a long text goes through several."""
    blocks: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        data = _PAD + text.encode().lower() + bytes([END])
        for at in range(0, len(data) - DEPTH, BYTES):
            part = byte_strings(np.frombuffer(data[at : at + BYTES + DEPTH], np.uint8))
            blocks.append(part)
            owner.append(np.full(len(part), i))
            size += len(part)
            if size >= BYTES:
                yield np.concatenate(blocks), np.concatenate(owner)
                blocks, owner, size = [], [], 0
    if blocks:
        yield np.concatenate(blocks), np.concatenate(owner)


def distinct(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys without repeats, and how often each was there (or the sum of n)."""
    if n is None:
        s = np.sort(keys)
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, int)
        return s[first], np.diff(np.r_[first, len(s)])
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, int)
    return s[first], np.add.reduceat(n[order], first) if len(s) else n[:0]


def _train(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS != HELD


def string_counts(docs: DataFrame) -> DataFrame:
    """key, n: the byte strings of all texts, and how often training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        new: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return distinct(np.concatenate([keys, *(x[0] for x in new)]), np.concatenate([sums, *(x[1] for x in new)]))

        for b in batches:
            learn = b.column(0).to_numpy(zero_copy_only=False)
            texts = strings(b.column(1))
            for flag in (True, False):
                for k, _ in windows([t for t, f in zip(texts, learn, strict=True) if f == flag]):
                    u, c = distinct(k)
                    new.append((u, c if flag else np.zeros(len(u), np.int64)))
                    size += len(u)
                    if size >= GATHERED // 4:  # a merge holds several copies of what it merges
                        keys, sums = merged()
                        new, size = [], 0
                        if len(keys) >= GATHERED:
                            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["key", "n"])
                            keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["key", "n"])

    return arrow_map(docs.select("train", "text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x >= 0.5: Stirling's series at x + 8."""
    y = x + 8
    below = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y - below


class Nodes:
    """The nodes of one depth, sorted: key is context * 256 + the bits so far, with a leading one.

    up: the place of each node of the depth below in this one.
    """

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray):
        self.key, self.zeros, self.ones, self.weighted = key, zeros, ones, weighted
        self.up = self.own = None

    @classmethod
    def of_strings(cls, keys: np.ndarray, n: np.ndarray) -> tuple[Nodes, np.ndarray]:
        """The nodes at full depth, and for each string the places of its eight."""
        byte, context = keys & 255, keys & ~np.int64(255)
        node = np.concatenate([context | (1 << k) | (byte >> (8 - k)) for k in range(8)])
        bit = np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)])
        key, at = np.unique(node, return_inverse=True)
        total = np.bincount(at, np.tile(n, 8), len(key))
        ones = np.bincount(at, np.tile(n, 8) * bit, len(key))
        return cls(key, total - ones, ones, kt(total - ones, ones)), at.reshape(8, -1)

    def parents(self) -> Nodes:
        """The nodes one byte of context less, weighted."""
        key, at = np.unique((self.key >> 16 << 8) | (self.key & 255), return_inverse=True)
        zeros, ones, below = (np.bincount(at, x, len(key)) for x in (self.zeros, self.ones, self.weighted))
        alone = kt(zeros, ones)
        out = Nodes(key, zeros, ones, np.logaddexp(alone, below) - _LN2)
        out.up, out.own = at, np.exp(alone - _LN2 - out.weighted)
        return out

    def chance(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def hand_down(self, below: Nodes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of a one at the root is a + b * (what this depth says): the same for the depth below."""
        own = np.where((below.zeros + below.ones) > 0, self.own[self.up], 1.0)  # unseen below: this node answers
        a, b = a[self.up], b[self.up]
        return a + b * own * self.chance()[self.up], b * (1 - own)


def climb(nodes: Nodes, steps: int) -> list[Nodes]:
    """The nodes of this depth and of so many depths above it, deepest first."""
    out = [nodes]
    for _ in range(steps):
        out.append(out[-1].parents())
    return out


def descend(levels: list[Nodes], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for above, below in zip(levels[:0:-1], levels[-2::-1], strict=True):
        a, b = above.hand_down(below, a, b)
    return a, b


def _groups(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by key, in blocks of ROWS or more that hold whole groups (key >> shift)."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        size += b.num_rows
        if size < ROWS:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        group = cols[0] >> shift
        cut = int(np.searchsorted(group, group[-1], "left"))
        if cut:
            yield [c[:cut] for c in cols]
        held, size = [[c[cut:] for c in cols]], len(group) - cut
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _at(group: F.Column, rows: DataFrame) -> DataFrame:
    """Groups whole in a task, sorted by key (and rows from above first)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "above"] if "above" in rows.columns else ["key"]
    return rows.withColumn("_group", group).repartition(n, "_group").drop("_group").sortWithinPartitions(*order)


_NODE = "key long, zeros double, ones double, weighted double"
_FROM_ABOVE = "key long, a double, b double"


def _node_batch(x: Nodes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": x.key, "zeros": x.zeros, "ones": x.ones, "weighted": x.weighted})


def learn(counts: DataFrame) -> DataFrame:
    """key, lp: the log10 probability of the last byte of each byte string after the others.

    counts: key, n (once each).  Without training texts all bytes have 1/256.
    """
    low, high = 8 * (DEPTH - LOWER + 1), 8 * (LOWER - UPPER + 1)  # bits of a key below its group

    def leaves_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _groups(batches, low):
            yield _node_batch(climb(Nodes.of_strings(key, n)[0], DEPTH - LOWER)[-1])

    def middle_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches, high):
            yield _node_batch(climb(_merged(*cols), LOWER - UPPER)[-1])

    counts = stage(counts, "byte-strings")
    lower = stage(arrow_map(_at(F.shiftright("key", low), counts), leaves_up, _NODE), "lower-contexts")
    upper = arrow_map(_at(F.shiftright("key", high), lower), middle_up, _NODE)
    top = upper.toPandas()  # contexts of one byte: 256 * 255 rows at most
    levels = climb(_merged(*(top[c].to_numpy() for c in top)), UPPER)
    root = levels[-1]
    a, b = descend(levels, np.zeros(len(root.key)), np.ones(len(root.key)))
    begin = levels[0].key, a, b

    def middle_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches, high):
            here = climb(_merged(*cols), LOWER - UPPER)
            at = np.searchsorted(begin[0], here[-1].key)
            a, b = descend(here, begin[1][at], begin[2][at])
            yield pa.RecordBatch.from_pydict({"key": here[0].key, "a": a, "b": b})

    def leaves_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, above, n, a, b in _groups(batches, low):
            key, n, up, a, b = key[~above], n[~above], key[above], a[above], b[above]
            leaves, places = Nodes.of_strings(key, n)
            here = climb(leaves, DEPTH - LOWER)
            at = np.searchsorted(up, (here[-1].key >> 8 << low) | (here[-1].key & 255))
            a, b = descend(here, a[at], b[at])
            one = a + b * leaves.chance()
            byte = key & 255
            lp = sum(np.log(np.where((byte >> (7 - k)) & 1, one[places[k]], 1 - one[places[k]])) for k in range(8)) / _LN10
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lp)], ["key", "lp"])

    middle = arrow_map(_at(F.shiftright("key", high), lower), middle_down, _FROM_ABOVE)
    # a node of the context in which a group's strings end stands before them: its place is the context's, its bits are the last byte
    middle = middle.select(F.expr(f"shiftleft(shiftright(key, 8), {low}) + (key & 255)").alias("key"), F.lit(True).alias("above"), F.lit(0).cast("long").alias("n"), "a", "b")
    below = counts.select("key", F.lit(False).alias("above"), "n", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    both = below.unionByName(middle)
    return stage(arrow_map(_at(F.shiftright("key", low), both), leaves_down, "key long, lp double"), "byte-model")


def _merged(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> Nodes:
    order = np.argsort(key)
    return Nodes(key[order], zeros[order], ones[order], weighted[order])


class Model:
    """lp by key, in a table with open addresses; keys that it doesn't have add nothing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (3 * len(keys) // 2).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several at one place the last stays
            here = self.keys[at] == keys[left]
            self.values[at[here]] = values[left[here]]
            left, at = left[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        out = self.values[at]
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[left] = self.values[at]
            more = (self.keys[at] != keys[left]) & (self.keys[at] != -1)
            left, at = left[more], at[more]
        return out


def _gathered(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys and values of a model of bounded size, brought to the driver a packed block at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([b"".join(x.column(n).to_numpy().tobytes() for x in held)], pa.binary()) for n in ("key", "lp")})

    rows = list(arrow_map(model.coalesce(8), pack, "key binary, lp binary").toLocalIterator())
    return np.frombuffer(b"".join(r["key"] for r in rows), np.int64), np.frombuffer(b"".join(r["lp"] for r in rows))


def _words(texts: list[str], rids: np.ndarray, learn: np.ndarray) -> Iterator[pa.RecordBatch]:
    """word, n (in training texts), rids, counts: the words of these texts, and " " once in each as its end."""
    some: list[bytes] = []
    sizes: list[int] = []
    whose: list[int] = []
    size = 0

    def out() -> pa.RecordBatch:
        ids: dict[bytes, int] = defaultdict(count().__next__)
        w = np.fromiter(map(ids.__getitem__, some), np.int64, len(some))
        pair, n = distinct(w << 32 | np.repeat(whose, sizes))
        w, i = pair >> 32, pair & 0xFFFFFFFF
        ends = np.cumsum(np.bincount(w, minlength=len(ids)))
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(x, t))
        trained = np.bincount(w, n * learn[i], len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(trained), lists(rids[i], pa.int64()), lists(n, pa.int64())], ["word", "n", "rids", "counts"])

    for i, text in enumerate(texts):
        data = text.encode().lower()
        at = 0
        while at < len(data) or not at:
            to = at + WORD_BYTES
            while to < len(data) and data[to] not in b" \t\n\v\f\r":
                to += 1
            words = data[at:to].split()
            if not at:
                words.append(b" ")
            some += words
            sizes.append(len(words))
            whose.append(i)
            size += min(to, len(data)) - at
            at = to
            if size >= WORD_BYTES:
                yield out()
                some, sizes, whose, size = [], [], [], 0
    if sizes:
        yield out()


_ROWS = "rid long, doc_id long, train boolean, n_tokens long, n_bytes long, lp double, word binary, n long, pairs array<long>"


def _read(docs: DataFrame, score: Callable[[list[str]], np.ndarray] | None) -> DataFrame:
    """Rows of two kinds, staged: one for each row of docs (word null; lp null without a score), and the words of some texts together.

    A word has a number for each of its texts, in one list to keep rows small: (the text's rid - its own) << 32 | count.
    """
    names = [x.split()[0] for x in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        size = 0

        def words() -> Iterator[pa.RecordBatch]:
            for w in _words([t for x in held for t in x[0]], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])):
                of_rows = [pa.nulls(w.num_rows, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())]
                word, n, rids, counts = w.columns
                first = pc.min(rids.values)
                pairs = pa.ListArray.from_arrays(rids.offsets, pc.bit_wise_or(pc.shift_left(pc.subtract(rids.values, first), 32), counts.values))
                yield pa.RecordBatch.from_arrays([pa.repeat(first, w.num_rows), *of_rows, word, n, pairs], names)

        for b in batches:
            texts = strings(b.column(3))
            data = [t.encode() for t in texts]
            tokens, lengths = [len(x.split()) + 1 for x in data], [len(x) for x in data]
            lp = pa.array(score(texts)) if score else pa.nulls(len(texts), pa.float64())
            of_words = [pa.nulls(len(texts), t) for t in (pa.binary(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(tokens, pa.int64()), pa.array(lengths, pa.int64()), lp, *of_words], names)
            if texts:
                held.append((texts, b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)))
                size += sum(lengths)
            if size >= WORD_BYTES:
                yield from words()
                held, size = [], 0
        if held:
            yield from words()

    return stage(arrow_map(docs, run, _ROWS, keeps="byte-model"), "lm-rows")


def _scorer(model: DataFrame) -> tuple[Callable[[list[str]], np.ndarray], Broadcast]:
    """What texts have by the strings of this model, which goes to the executors."""
    name = "byte-model", uuid.uuid4().hex
    found = model.sparkSession.sparkContext.broadcast(_gathered(model))

    def score(texts: list[str]) -> np.ndarray:
        cache = worker_cache()
        if name not in cache:
            forget()  # another run's
            cache[name] = Model(*found.value)
        out = np.zeros(len(texts))
        for keys, owner in windows(texts):
            out += np.bincount(owner, cache[name](keys), len(texts))
        return out

    return score, found


def _by_parts(docs: DataFrame, model: DataFrame, parts: int) -> DataFrame:
    """rid, lp by a model too large to be sent whole: a pass over the texts for each part of it, and no string of a text is shuffled."""

    def of(score: Callable[[list[str]], np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(strings(b.column(1))))], ["rid", "lp"])

        return run

    sums = []
    for k in range(parts):
        score, found = _scorer(model.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == k))
        sums.append(stage(arrow_map(docs.select("rid", "text"), of(score), "rid long, lp double", keeps="byte-model"), "lm-part"))
        found.destroy()
    return reduce(DataFrame.unionByName, sums).groupBy("rid").agg(F.sum("lp").alias("lp"))


def score_texts(docs: DataFrame, sent: int = SENT) -> DataFrame:
    """For every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows whose crc32(doc_id as text) mod FOLDS is HELD are held out and not learnt from (a null doc_id is
    hashed as the empty text).  Null texts are empty: one end.  base_score: sum over words and an end of
    log10((c + 1) / (N + V + 1)).  score: log10 of the tree's probability of the text's bytes and its end;
    bits_per_byte: its code length over them.  Repeated rows are learnt from and scored each.
    """
    rows = only(docs, doc_id="long", text="string").withColumn("train", _train(F.col("doc_id")))
    model = learn(string_counts(rows))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "train", "text")
    if (size := model.count()) <= sent:
        read = _read(rows, _scorer(model)[0])
        scores = read.filter("word IS NULL")
    else:
        rows = stage(rows, "lm-texts")
        read = _read(rows, None)
        scores = read.filter("word IS NULL").drop("lp").join(_by_parts(rows, model, max(2, -(-size // PART))), "rid")
    words = read.filter("word IS NOT NULL")
    known = stage(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    total = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).head()
    each = words.select("word", "rid", "pairs").join(known, "word").select("c", "rid", F.explode("pairs").alias("pair"))
    each = each.select("c", (F.col("rid") + F.shiftright("pair", 32)).alias("rid"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("times"))
    share = F.log10((F.col("c") + 1) / F.lit(float(total["n"] + total["v"] + 1)))
    base = each.groupBy("rid").agg(F.sum(F.col("times") * share).alias("base_score"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"))
    bits = (-F.col("lp") * F.lit(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte")
    return scores.join(base, "rid").select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(total["n"])).cast("long").alias("train_tokens"), "base_score", F.col("lp").alias("score"), bits)
