"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated trigram model with absolute discounting over
every n-gram of the training texts, also those seen once:
``p3 = a3 + b3 * (a2 + b2 * p1)``, with ``a`` the discounted share of the
n-gram in its context, ``b`` the mass the discount leaves to the lower order
and ``p1`` the add-a-half word probability.

1. Documents are cut into blocks of about ``BLOCK_TOKENS`` tokens and written
   once as word numbers, frequent words first, with each block's word hashes.
2. Words are summed by ranges of their hash: N, V and the words so frequent
   that one shard can't take all n-grams around them.
3. A block sends its distinct trigrams (u, v, w) to the shard of the middle
   word v, as one packed message a shard, which names the ``COMMON`` most
   frequent words by rank and others by hash. So a shard has all that its
   n-grams need: pairs (v, w), contexts (u, v) and the count of v. The
   trigrams of a frequent v are split by u, and each of its shards also gets
   the pair counts of the others.
4. A shard merges its messages and packs them into its trie: Elias-Fano word
   hashes, monotone pointers from each word to its successors and contexts
   and from each context to its successors, which are numbered relative to
   the successors of the shorter context, and 16-bit logarithms of ``a`` and
   ``b``. The trie lies in one memory map. Every message is then answered by
   successor search with what the trie holds: counts of words and the codes
   of ``b2`` (a word), ``a2`` (a pair), ``a3`` and ``b3`` (a trigram). Few
   different codes are common, so they pack well as they are.
5. Answers meet their block again, which sums log probabilities by document.
   Nothing of a score depends on how the documents are dealt to blocks.

A message is pre-summed, so a word, pair or passage that fills a third of all
texts is one entry a block. No n-gram is dropped and no table of words or
n-grams reaches the driver but the words to split (each more than
``SHARD_ENTRIES`` / 4 times, so at most one in that many tokens) and a bounded
number of candidates for the most frequent ones.

A token is a word (anything but ASCII white space, A-Z lower-cased) or the
end of a text. Words are known by a 56-bit hash. Defined results: null text
is empty (one end token); a null id trains; repeated rows each train and are
each scored; without training tokens every token has the same probability;
other columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import mmap

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize, ship, text_of
from .elias_fano import EliasFano, encode

#: Folds by crc32 of the id; that which is held out.
FOLDS, HELD_OUT, DISCOUNT = 5, 1, 0.75
#: Hashes of what is no word: text end and begin. Bits of a word's hash (a
#: pair of 10 ** 8 words shares one with probability 0.07), and of that by
#: which a context's first word is told from others before the same word.
END, BEGIN, HASH_BITS, FIRST_BITS = 1, 2, 56, 40
#: Sizes of a block and a shard; words remembered by a task (of 64 bytes at most).
BLOCK_TOKENS, SHARD_ENTRIES, CACHE = 1 << 22, 3 << 20, 200_000
#: The most frequent words, which messages name by rank (8 bytes each in every task).
COMMON = 1 << 16
#: Values worked on at once where a whole column would need several copies.
SLICE = 1 << 18
RESULT = (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))


class Known(dict):
    """Word hashes; remembers a bounded number of short words."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = max(self.hash(word) >> 64 - HASH_BITS, 3)  # 1 and 2 are no words
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


def squeeze(x: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    import pyarrow as pa

    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return x.dtype.str.encode().ljust(4) + len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=2).compress(planes, asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    import pyarrow as pa

    kind, n = np.dtype(data[:4].decode().strip()), int.from_bytes(data[4:12], "little")
    planes = pa.Codec("zstd").decompress(data[12:], n * kind.itemsize, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def joined(parts: list[bytes]) -> bytes:
    """Byte strings as one; ``parted`` undoes it."""
    return np.array([len(parts), *map(len, parts)], "<u8").tobytes() + b"".join(parts)


def parted(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u8", n, 8).astype(np.int64))])
    return [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows equal in all (sorted) columns begins."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def ranked(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words by falling count, then hash, and each one's number."""
    own, number, n = np.unique(words, return_inverse=True, return_counts=True)
    by = np.lexsort((own, -n))
    to = np.empty(len(by), np.uint32)
    to[by] = np.arange(len(by), dtype=np.uint32)
    return own[by], to[number]


def order_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The order by (a, b, c); small numbers are sorted as one."""
    bits = [int(x.max()).bit_length() if len(x) else 0 for x in (b, c)]
    if len(a) and int(a.max()).bit_length() + sum(bits) <= 63:
        key = a.astype(np.int64)
        for x, k in ((b, bits[0]), (c, bits[1])):
            key <<= k
            key |= x
        return np.argsort(key, kind="stable")
    return np.lexsort((c, b, a))


# Blocks


def blocks_of(rows: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``rows`` (doc_id, held_out, text) as blocks: block, ids, held, sizes,
    words (hashes), codes (a number a token)."""
    import pyarrow as pa

    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()), T.StructField("codes", T.BinaryType()),
    ])

    def cut(batches):
        from pyspark import TaskContext

        pid, serial, known = TaskContext.get().partitionId(), 0, Known()
        get, ids, held, sizes, parts, size = known.__getitem__, [], [], [], [], 0

        def flush():
            begins = np.full(len(parts), BEGIN, np.uint64)  # a word as well, for the first contexts
            words, codes = ranked(np.concatenate([*parts, begins]))
            codes = codes[: len(codes) - len(parts)]
            one = lambda x, t: pa.array([x], t)
            listed = pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids))
            return pa.RecordBatch.from_arrays(
                [
                    one((pid << 32) + serial, pa.int64()), listed, one(held, pa.list_(pa.bool_())), one(sizes, pa.list_(pa.int64())),
                    one(squeeze(np.diff(words, prepend=np.uint64(0))), pa.binary()), one(squeeze(codes), pa.binary()),
                ],
                names=schema.names,
            )

        for batch in batches:
            texts, flags = batch.column(2).cast(pa.binary()), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                h = list(map(get, texts[k].as_py().lower().split()))
                h.append(END)
                ids.append(batch.column(0).slice(k, 1))
                held.append(flags[k])
                sizes.append(len(h))
                parts.append(np.array(h, np.uint64))
                size += len(h)
                if size >= block_tokens:
                    yield flush()
                    serial += 1
                    ids, held, sizes, parts, size = [], [], [], [], 0
                    give_back()
        if parts:
            yield flush()
        del parts
        give_back()

    return rows.mapInArrow(cut, schema)


class Block:
    """One block's tokens: the distinct trigrams (u, v, w as numbers into
    ``words``) in the order of their shard, then v, w, u."""

    def __init__(self, words: bytes, codes: bytes, held: list, sizes: list, heavy: tuple[np.ndarray, np.ndarray], shards: int, common: np.ndarray):
        self.words, w = np.cumsum(unsqueeze(words), dtype=np.uint64), unsqueeze(codes).view(np.int32)
        # numbers: common words by rank, then others by hash
        at = rank_of(self.words, common)
        by = np.lexsort((self.words, np.where(at < 0, len(common), at)))
        self.ranks, self.words = at[by], self.words[by]
        number = np.empty(len(by), np.int32)
        number[by] = np.arange(len(by), dtype=np.int32)
        w = number[w]
        del at, by, number
        begin = int(np.flatnonzero(self.words == BEGIN)[0])
        self.sizes, self.w = np.asarray(sizes, np.int64), w
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        v, u = np.empty_like(w), np.empty_like(w)
        v[1:], u[2:] = w[:-1], w[:-2]
        v[self.firsts] = u[self.firsts] = begin
        seconds = self.firsts[self.sizes > 1] + 1
        u[seconds] = begin
        by = order_of(v, w, u).astype(np.int32)
        at = starts(v[by], w[by], u[by])
        train = np.repeat(~np.asarray(held, bool), self.sizes)
        n = np.add.reduceat(train[by].astype(np.int32), at) if len(at) else at
        of = np.empty(len(by), np.int32)
        new = np.zeros(len(by), np.int32)
        new[at[1:]] = 1
        of[by] = np.cumsum(new, dtype=np.int32)  # the trigram of each token
        del new
        first = by[at]
        del by, train
        self.v, self.u, x = v[first], u[first], w[first]
        del first, at, v, u
        parts, part = self.split(heavy)
        shard = shard_of(self.words[self.v], part, shards).astype(np.int32)
        del part
        deal = np.argsort(shard, kind="stable").astype(np.int32)
        self.v, self.u, self.x, self.n, self.shard, self.parts = (c[deal] for c in (self.v, self.u, x, n, shard, parts))
        back = np.empty(len(deal), np.int32)
        back[deal] = np.arange(len(deal), dtype=np.int32)
        self.of = back[of]
        self.edges = np.searchsorted(self.shard, np.arange(shards + 1))
        self.shards = shards

    def split(self, heavy) -> tuple[np.ndarray, np.ndarray]:
        """How many parts each trigram's v has, and which it belongs to."""
        h = self.words[self.v]
        parts, part = np.ones(len(h), np.int32), np.zeros(len(h), np.uint64)
        if len(heavy[0]) and len(h):
            at = np.minimum(np.searchsorted(heavy[0], h), len(heavy[0]) - 1)
            is_heavy = heavy[0][at] == h
            parts[is_heavy] = heavy[1][at[is_heavy]]
            part[is_heavy] = scramble(self.words[self.u[is_heavy]] + np.uint64(7)) % parts[is_heavy].astype(np.uint64)
        return parts, part

    def elsewhere(self) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """By shard: v, w and counts of the pairs of split words that this
        block sends to another shard of the same v."""
        at = np.flatnonzero((self.parts > 1) & (self.n > 0))
        at = at[order_of(self.v[at], self.x[at], self.u[at])]
        edges = np.append(starts(self.v[at]), len(at))
        out: dict[int, list] = {}
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            k = at[i:j]
            pair = starts(self.x[k])
            of = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(k))))
            total, parts = np.add.reduceat(self.n[k], pair), int(self.parts[k[0]])
            every = shard_of(np.full(parts, self.words[self.v[k[0]]]), np.arange(parts, dtype=np.uint64), self.shards)
            for s in np.unique(every):
                rest = total - np.bincount(of, self.n[k] * (self.shard[k] == s), len(pair)).astype(np.int64)
                some = rest > 0
                if some.any():
                    out.setdefault(int(s), []).append((self.v[k[pair]][some], self.x[k[pair]][some], rest[some]))
        return out

    def messages(self):
        """(shard, message): the words v and w, the first words u, then v, w,
        u as steps, counts, and the same without u for pairs sent elsewhere."""
        others = self.elsewhere()
        none = np.zeros(0, np.int64)
        for s in sorted({*np.unique(self.shard).tolist(), *others}):
            cut = slice(self.edges[s], self.edges[s + 1])
            v, x, u, n = self.v[cut], self.x[cut], self.u[cut], self.n[cut]
            ev, ex, en = (np.concatenate(c) for c in zip(*others[s], strict=True)) if s in others else (none, none, none)
            used, places = numbered(len(self.words), v, x, ev, ex)
            v, x, ev, ex = (places[c] for c in (v, x, ev, ex))
            before, places = numbered(len(self.words), u)
            u = places[u]
            lists = [told(self.ranks[used], self.words[used]), told(self.ranks[before], first_words(self.words[before]))]
            yield s, joined([*lists, *(squeeze(c) for c in (*steps(v, x, u), n.astype(np.uint32), *(c.astype(np.uint32) for c in (ev, ex, en))))])


def rank_of(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Places of ``words`` in ``common``, -1 where they are not in it."""
    if not len(common):
        return np.full(len(words), -1)
    by = np.argsort(common)
    at = by[np.minimum(np.searchsorted(common, words, sorter=by), len(common) - 1)]
    return np.where(common[at] == words, at, -1)


def told(ranks: np.ndarray, hashes: np.ndarray) -> bytes:
    """Words in the order of their numbers: ranks of common ones, then hashes."""
    k = int((ranks >= 0).sum())
    return joined([squeeze(np.diff(ranks[:k], prepend=0).astype(np.uint32)), squeeze(np.diff(hashes[k:], prepend=np.uint64(0)))])


def heard(data: bytes, common: np.ndarray) -> np.ndarray:
    """Undoes ``told`` with the hashes of the common words."""
    ranks, rest = map(unsqueeze, parted(data))
    return np.concatenate([common[np.cumsum(ranks, dtype=np.int64)], np.cumsum(rest, dtype=np.uint64)])


def first_words(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(HASH_BITS - FIRST_BITS)


def shard_of(v: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return (scramble(v + part * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(shards)).astype(np.int64)


def numbered(size: int, *ids: np.ndarray) -> tuple[np.ndarray, np.ndarray | Places]:
    """The different ``ids`` (below ``size``), and what gives each one's place among them."""
    if size > 8 * sum(map(len, ids)):
        used = np.unique(np.concatenate(ids))
        return used, Places(used)
    mark = np.zeros(size, bool)
    for c in ids:
        mark[c] = True
    return np.flatnonzero(mark), np.cumsum(mark, dtype=np.int32) - 1


class Places:
    """Places by search, where a table by number would be mostly empty."""

    def __init__(self, used: np.ndarray):
        self.used = used

    def __getitem__(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.used, ids).astype(np.int32)


def steps(*columns: np.ndarray):
    """Sorted rows as differences to the row before, each column from anew
    where a column before it changes."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        d = np.diff(c, prepend=0)
        yield np.where(new, c, d).astype(np.uint32)
        new |= d != 0


def unsteps(*columns: np.ndarray):
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for d in columns:
        c = np.cumsum(d, dtype=np.int64)
        at = np.flatnonzero(new)
        if len(at):
            c -= np.repeat(c[at] - d[at], np.diff(np.append(at, len(c))))
        yield c
        new[1:] |= c[1:] != c[:-1]


# Words


def word_facts(blocks: DataFrame, shard_entries: int) -> dict:
    """What the model needs to know before n-grams are dealt: sizes of the
    training texts, shards, and the words to split with their parts."""
    import pyarrow as pa

    whole = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    size = blocks.agg(F.sum(whole).alias("all"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("docs")).first()
    total, docs = size["all"] or 0, size["docs"] or 0
    ranges, limit = max(1, -(-total // (8 * shard_entries))), max(1, shard_entries // 4)

    def count(batches):
        for batch in batches:
            for words, codes, held, sizes in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                w, c = np.cumsum(unsqueeze(words), dtype=np.uint64), unsqueeze(codes)
                n = np.bincount(c[np.repeat(~np.asarray(held, bool), sizes)], minlength=len(w))
                some = np.flatnonzero(n)
                some = some[np.argsort(w[some])]
                w, n = w[some], n[some]
                edges = np.searchsorted((w >> np.uint64(HASH_BITS - 24)) * np.uint64(ranges) >> np.uint64(24), np.arange(ranges + 1))
                rows = [(k, joined([squeeze(np.diff(w[i:j], prepend=np.uint64(0))), squeeze(n[i:j].astype(np.uint32))])) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["range", "data"])

    def merge(batches):
        def flush(data):
            both = [[unsqueeze(c) for c in parted(d)] for d in data]
            w, of = np.unique(np.concatenate([np.cumsum(a, dtype=np.uint64) for a, _ in both]), return_inverse=True)
            n = np.bincount(of, np.concatenate([b for _, b in both])).astype(np.int64)
            first = np.lexsort((w, -n))[: max(int((n > limit).sum()), -(-2 * COMMON // ranges))]
            return pa.RecordBatch.from_arrays(
                [pa.array([None, *w[first].view(np.int64).tolist()], pa.int64()), pa.array([len(w), *[0] * len(first)], pa.int64()), pa.array([int(n.sum()), *n[first].tolist()], pa.int64())], names=["w", "words", "n"]
            )

        for _, rows in grouped(batches):
            yield flush([r[1] for r in rows])
            give_back()

    sent = blocks.select("words", "codes", "held", "sizes").mapInArrow(count, "range long, data binary")
    found = sent.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "w long, words long, n long").collect()  # a row a range, the words to split, 2 * COMMON others
    named = [(r.w % (1 << 64), r.n) for r in found if r.w is not None]
    common = sorted((w for w in named if w[1] > 1), key=lambda w: (-w[1], w[0]))[:COMMON]
    heavy = sorted([(w, -(-n // limit)) for w, n in named if n > limit and w != END] + ([(BEGIN, -(-docs // limit))] if docs > limit else []))
    sums = [r for r in found if r.w is None]
    return {
        "train_tokens": sum(r.n for r in sums), "vocabulary": sum(r.words for r in sums), "train_docs": docs, "shards": max(1, -(-total // shard_entries)),
        "common": np.array([w for w, _ in common], np.uint64), "heavy": (np.array([w for w, _ in heavy], np.uint64), np.array([k for _, k in heavy], np.int64)),
    }


def grouped(batches):
    """Rows of equal (sorted) first column: (value, rows)."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


# Shards


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest value and step, 16-bit codes from 1) of logarithms; minus infinity is code 0."""
    some = np.isfinite(x)
    lo, hi = (float(x[some].min()), float(x[some].max())) if some.any() else (0.0, 0.0)
    step = (hi - lo) / ((1 << 16) - 2) or 1.0
    codes = np.empty(len(x), "<u2")
    for i in range(0, len(x), SLICE):
        k = slice(i, i + SLICE)
        codes[k] = np.where(some[k], np.round((np.where(some[k], x[k], lo) - lo) / step) + 1, 0)
    return np.array([lo, step], "<f8"), codes


def powers(scale: np.ndarray, codes: np.ndarray, missing: float) -> np.ndarray:
    """What codes stand for; code 0 stands for ``missing``."""
    if len(codes) > 65536:
        return np.append(missing, 10.0 ** (scale[0] + scale[1] * np.arange(65535)))[codes]
    return np.where(codes > 0, 10.0 ** (scale[0] + scale[1] * (codes.astype(np.float64) - 1)), missing)


def by_frequency(codes: np.ndarray) -> list[np.ndarray]:
    """The different codes by falling frequency, and the place of each code
    among them: nearly all places fit the lower byte."""
    values, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.uint32)
    place[order] = np.arange(len(order))
    return [values[order], place[which]]


def merged(messages: list[bytes], common: np.ndarray) -> bytes:
    """The trie of all training n-grams in ``messages``."""
    tables = common, first_words(common)
    words, firsts = (distinct(heard(parted(m)[k], tables[k]) for m in messages) for k in (0, 1))
    columns: list[list] = [[] for _ in range(7)]
    for m in messages:  # one at a time, as they take several times their size
        p = parted(m)
        to, before = (np.searchsorted(all_, heard(c, t)).astype(np.int32) for all_, c, t in zip((words, firsts), p[:2], tables, strict=True))
        p[2:] = map(unsqueeze, p[2:])
        v, x, u = unsteps(*p[2:5])
        some = np.flatnonzero(p[5])
        for column, c in zip(columns, (to[v[some]], to[x[some]], before[u[some]], p[5][some], to[p[6]], to[p[7]], p[8]), strict=True):
            column.append(c)
        del p, to, before, v, x, u, some
    v, x, u, n, ev, ex, en = (np.concatenate(columns.pop(0)) for _ in range(7))  # each list goes as its column comes
    used, places = numbered(len(words), v, x, ev, ex)
    v, x, ev, ex = (places[c] for c in (v, x, ev, ex))
    before, places = numbered(len(firsts), u)
    u = places[u]
    words, firsts = words[used], firsts[before]
    del used, before, places
    by = order_of(v, u, x).astype(np.int32)
    at = starts(v[by], u[by], x[by])
    n = np.add.reduceat(n[by].astype(np.int64), at) if len(at) else n.astype(np.int64)
    first = by[at]
    del by, at
    v, u, x = v[first], u[first], x[first]
    del first
    give_back()
    return packed(words, firsts, v, u, x, n, ev, ex, en.astype(np.int64))


def distinct(parts) -> np.ndarray:
    """The sorted different values of many arrays, joined a few at a time."""
    found, held, size = np.zeros(0, np.uint64), [], 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size > max(1 << 20, 2 * len(found)):
            found, held, size = np.unique(np.concatenate([found, *held])), [], 0
    return np.unique(np.concatenate([found, *held]))


def packed(words, firsts, v, u, x, n, ev, ex, en) -> bytes:
    """A trie from merged triples (sorted by v, u, w) and pairs counted elsewhere."""
    size, before = max(1, len(words)), max(1, len(firsts))
    long = lambda c: c.astype(np.int64)  # noqa: E731  # for products of two numbers
    log = lambda a: np.log10(a) if len(a) else np.zeros(0)
    levels = [encode(words, 1 << HASH_BITS), encode(firsts, 1 << FIRST_BITS)]
    pv, px, pn = np.concatenate([v, ev]), np.concatenate([x, ex]), np.concatenate([n, en])
    by = order_of(pv, px, np.zeros(len(pv), np.int32)).astype(np.int32)
    at = starts(pv[by], px[by])
    pn = np.add.reduceat(pn[by], at) if len(at) else pn
    first = by[at]
    del by, at
    pv, px = pv[first], px[first]
    del first
    root = starts(pv)
    degree = np.diff(np.append(root, len(pv)))
    total = np.add.reduceat(pn, root) if len(root) else pn
    most = int(degree.max()) if len(degree) else 1
    values = [quantised(log((pn - DISCOUNT) / np.repeat(total, degree))), quantised(log(DISCOUNT * degree / total))]
    del pn
    pair_key, heads = long(pv) * size + px, pv[root]
    levels += [encode(heads, size), encode(np.append(0, np.cumsum(total)), int(total.sum()) + 1), encode(np.append(root, len(pv)), len(pv) + 1)]
    del pv
    levels.append(encode(np.repeat(np.arange(len(root)), degree) * size + px, max(1, len(root) * size)))
    del px
    context = starts(v, u)
    degree3 = np.diff(np.append(context, len(v)))
    total3 = np.add.reduceat(n, context) if len(context) else n
    values += [quantised(log((n - DISCOUNT) / np.repeat(total3, degree3))), quantised(log(DISCOUNT * degree3 / total3))]
    del total3
    root_of = np.searchsorted(heads, v[context])
    levels += [encode(root_of * before + u[context], max(1, len(root) * before)), encode(np.append(context, len(v)), len(v) + 1)]
    place = np.searchsorted(pair_key, long(v) * size + x)
    del pair_key
    place -= np.repeat(root[root_of], degree3)
    place += np.repeat(np.arange(len(context)) * most, degree3)
    levels.append(encode(place, max(1, len(context) * most)))
    scales, codes = zip(*values, strict=True)
    return b"".join([np.array([size, before, most, *map(len, codes)], "<u8").tobytes(), *levels, *(s.tobytes() for s in scales), *(c.tobytes() + b"\0" * (-2 * len(c) % 8) for c in codes)])


class Trie:
    """Views into a packed trie."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<u8", 7).astype(np.int64).tolist()
        self.size, self.before, self.most = head[:3]
        at, levels = 56, []
        for _ in range(9):
            levels.append(EliasFano(buffer, at))
            at = levels[-1].end
        self.words, self.firsts, self.roots, self.totals, self.first2, self.next2, self.contexts, self.first3, self.next3 = levels
        scales = np.frombuffer(buffer, "<f8", 8, at).reshape(4, 2)
        at, self.values = at + 64, []
        for scale, n in zip(scales, head[3:], strict=True):
            self.values.append((scale, np.frombuffer(buffer, "<u2", n, at)))
            at += -(-2 * n // 8) * 8

    @staticmethod
    def mapped(data: bytes) -> Trie:
        """A trie in a memory map of its own, outside of Python's heap."""
        room = mmap.mmap(-1, max(1, len(data)))
        room.write(data)
        return Trie(room)

    def codes(self, which: int, at: np.ndarray) -> np.ndarray:
        """Codes of a level's values; 0 where the place is negative."""
        out = np.zeros(len(at), np.uint16)
        some = at >= 0
        out[some] = self.values[which][1][at[some]]
        return out

    def ask(self, words: np.ndarray, firsts: np.ndarray, v: np.ndarray, x: np.ndarray, u: np.ndarray):
        """For rows grouped by v, x (numbers into ``words``; u into
        ``firsts``): count and code of b2 of the different v, codes of a2 of
        the different (v, x), codes of a3 and b3 of each trigram (u, v, x)."""
        ids, before = self.words.find(words), self.firsts.find(firsts)
        first = starts(v)
        run = np.diff(np.append(first, len(v)))
        head = ids[v[first]]
        root = np.full(len(head), -1)
        root[head >= 0] = self.roots.find(head[head >= 0])
        known = np.flatnonzero(root >= 0)
        count, base = np.zeros(len(root), np.int64), np.zeros(len(root), np.int64)
        if len(known):
            r = root[known]
            count[known] = (self.totals.get(r + 1) - self.totals.get(r)).astype(np.int64)
            base[known] = self.first2.get(r).astype(np.int64)
        left2, root, base = self.codes(1, root), np.repeat(root, run), np.repeat(base, run)
        pair = starts(v, x)
        again = np.diff(np.append(pair, len(v)))
        r, w = root[pair], ids[x[pair]]
        at2, both = np.full(len(pair), -1), (r >= 0) & (w >= 0)
        at2[both] = self.next2.find(r[both] * self.size + w[both])
        share2, at2 = self.codes(0, at2), np.repeat(at2, again)
        first_word = before[u]
        context, both = np.full(len(v), -1), (root >= 0) & (first_word >= 0)
        context[both] = self.contexts.find(root[both] * self.before + first_word[both])
        at3, both = np.full(len(v), -1), (context >= 0) & (at2 >= 0)  # w counts from the first successor of the shorter context
        at3[both] = self.next3.find(context[both] * self.most + at2[both] - base[both])
        return count, left2, share2, self.codes(2, at3), self.codes(3, context)


def answered(trie: Trie, message: bytes, common: np.ndarray) -> bytes:
    p = parted(message)
    count, left2, share2, share3, left3 = trie.ask(heard(p[0], common), heard(p[1], first_words(common)), *unsteps(*map(unsqueeze, p[2:5])))
    both = by_frequency((share3.astype(np.uint32) << 16) | left3)  # a trigram's two codes come together
    return joined([squeeze(c) for c in (count, left2, *by_frequency(share2), *both, np.concatenate([scale for scale, _ in trie.values]))])


# The whole


def sent_messages(blocks: DataFrame, facts: dict) -> DataFrame:
    """shard, block, data."""
    import pyarrow as pa

    heavy, shards, common = facts["heavy"], facts["shards"], facts["common"]

    def send(batches):
        for batch in batches:
            for block, held, sizes, words, codes in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                out, size = [], 0
                for s, data in Block(words, codes, held, sizes, heavy, shards, common).messages():
                    out.append((s, block, data))
                    size += len(data)
                    if size > 1 << 23:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)
                del out
                give_back()

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "data"])

    return blocks.select("block", "held", "sizes", "words", "codes").mapInArrow(send, "shard long, block long, data binary")


def at_shards(messages: DataFrame, facts: dict, answers: bool) -> DataFrame:
    """shard, block, data: answers to all messages, or (block null) the
    tries. A row with block null already is its shard's trie."""
    import pyarrow as pa

    common = facts["common"]

    def run(batches):
        for s, rows in grouped(batches):
            given = [r[2] for r in rows if r[1] is None]
            data = given[0] if given else merged([r[2] for r in rows], common)
            if not answers:
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([None], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "data"])
                continue
            trie = Trie.mapped(data)
            del data, given
            give_back()
            for _, block, message in rows:
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([block], pa.int64()), pa.array([answered(trie, message, common)], pa.binary())], names=["shard", "block", "data"])

    dealt = messages.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(run, "shard long, block long, data binary")


def summed(blocks: DataFrame, answers: DataFrame, facts: dict) -> DataFrame:
    """doc_id and the results: each block meets its answers."""
    import pyarrow as pa

    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, t) for c, t in RESULT]])
    floor = facts["train_tokens"] + 0.5 * (facts["vocabulary"] + 1)
    total, docs, heavy, shards, common = (facts[k] for k in ("train_tokens", "train_docs", "heavy", "shards", "common"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, codes, held, sizes = (left.column(c)[0].as_py() for c in ("words", "codes", "held", "sizes"))
        b = Block(words, codes, held, sizes, heavy, shards, common)
        got = dict(zip(right.column("shard").to_pylist(), right.column("data").to_pylist(), strict=True))
        seen, low, high = np.zeros(len(b.words), np.int64), np.empty(len(b.v)), np.empty(len(b.v))
        for s, data in got.items():
            cut = slice(b.edges[s], b.edges[s + 1])
            count, left2, share2, place2, both, place3, scales = map(unsqueeze, parted(data))
            share2, both = share2[place2], both[place3]
            share3, left3 = both >> 16, both & 0xFFFF
            v, scales = b.v[cut], scales.reshape(4, 2)
            word, pair = starts(v), starts(v, b.x[cut])
            seen[v[word]] = count
            rest = powers(scales[3], left3, 1.0)
            high[cut] = powers(scales[2], share3, 0.0) + rest * np.repeat(powers(scales[0], share2, 0.0), np.diff(np.append(pair, len(v))))
            low[cut] = rest * np.repeat(powers(scales[1], left2, 1.0), np.diff(np.append(word, len(v))))
        seen[b.words == END] = docs
        p1 = (seen + 0.5) / floor
        p = np.log10(high + low * p1[b.x])
        add = lambda x: np.add.reduceat(x, b.firsts)
        ids = left.column("ids").combine_chunks().flatten()
        cols = [ids, pa.array(held), pa.array(b.sizes), pa.array(add((seen[b.w] > 0).astype(np.int64))), pa.array(np.full(len(held), total, np.int64)), pa.array(add(np.log10(p1)[b.w])), pa.array(add(p[b.of]))]
        del b, got, seen, low, high, p1, p
        give_back()
        return pa.Table.from_arrays(cols, names=schema.names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def train_model(texts: DataFrame, text: str = "text", block_tokens: int = BLOCK_TOKENS, shard_entries: int = SHARD_ENTRIES) -> tuple[DataFrame, dict]:
    """The tries of a model of all ``texts`` (shard, block null, data), written to the shared folder, and its facts."""
    ship(texts.sparkSession)
    rows = texts.select(F.lit(0).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), text_of(text).alias("text"))
    blocks = materialize(blocks_of(rows, block_tokens), "lm-blocks")
    facts = word_facts(blocks, shard_entries)
    return materialize(at_shards(sent_messages(blocks, facts), facts, False), "lm-tries"), facts


def score_with(docs: DataFrame, tries: DataFrame, facts: dict, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Scores of ``docs`` by a model that exists; ``held_out`` is true for all."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lit(True).alias("held_out"), text_of(text).alias("text"))
    blocks = materialize(blocks_of(rows, block_tokens), "lm-blocks")
    return summed(blocks, at_shards(sent_messages(blocks, facts).unionByName(tries), facts, True), facts)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every document, by a model of those that aren't held out."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), text_of(text).alias("text"))
    blocks = materialize(blocks_of(rows, block_tokens), "lm-blocks")
    facts = word_facts(blocks, shard_entries)
    return summed(blocks, at_shards(sent_messages(blocks, facts), facts, True), facts)
