"""Packing documents into token sequences: cutting stock by column generation.

1. Each document becomes token ids (closed by an end id). Blocks of a whole
   sequence are cut off; what remains is an item of 1 to ``capacity`` - 1 ids.
2. The counts of items by length (a histogram of at most ``capacity`` rows,
   whatever the corpus) go to the driver. In units of ``GRID`` ids, a linear
   program finds how often to use which pattern of lengths so that the fewest
   sequences cover all items; new patterns are priced by a knapsack dynamic
   program over the duals.
3. Pattern counts are rounded down. Items are ranked within their length
   class (one range exchange), and a rank alone says which sequence and slot
   an item has.
4. Items left over, and as many more as needed, are cut freely: end to end
   they form a stream that fills the room left in each sequence (an interval
   join in buckets of stream positions), then further full sequences. The
   last rest is split into powers of two, which need no padding.

Defined results: null and empty texts are one end id; repeated rows are
packed like any other; rows of an empty table give no pieces; other columns
don't matter. Token ids are stored once, compressed, in the shared folder, so
a lost executor costs no second tokenization.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ordered_rows, ship, text_of

CAPACITY, GRID, END_ID, TOKENIZER = 4096, 16, 2, "word_bpe_49k.json"
#: Chunks and words whose ids a worker remembers.
CACHE = 700_000
#: Closing marks that are a token run of their own after a word.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
ITEM = "uid long, {doc_id}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    White space parts tokens for this kind of tokenizer, so a text's ids are
    those of its space-parted chunks, and these are remembered. A new chunk
    that is a plain Latin word, perhaps with closing marks, is put together
    from the ids of the lower-cased word and of the marks; new words go
    through the tokenizer many at a time and are told apart by the tokens
    that end a word. Any other chunk is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.words = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def _learn(self, chunks) -> None:
        whole, parted, new = [], [], set()
        for c in chunks:
            word = c.rstrip(MARKS)
            if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
                word = word.lower()
                parted.append((c, word))
                if word not in self.words:
                    new.add(word)
            else:
                whole.append(c)
        new = list(new)
        for at in range(0, len(new), 200):
            part = new[at : at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):
                raise ValueError("this tokenizer doesn't mark where words end")
            raw, cut = ids.tobytes(), [0, *(4 * last).tolist()]
            for word, i, j in zip(part, cut, cut[1:]):
                self.words[word] = raw[i:j]
        for c, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            self.known[c] = np.array(e.ids, dtype="<u4").tobytes()
        for c, word in parted:
            tail = c[len(word) :]
            if tail and tail not in self.known:
                self.known[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids, dtype="<u4").tobytes()
            self.known[c] = self.words[word] + self.known[tail] if tail else self.words[word]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        if len(self.words) > CACHE:
            self.words = {}
        known = self.known
        self._learn({c for p in parts for c in p if c not in known})
        return [b"".join([known[c] for c in p]) for p in parts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process; it outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def items(docs: DataFrame, doc_id: str, text: str, capacity: int, end_id: int, name: str) -> DataFrame:
    """Blocks and items of all documents, written to the shared folder."""
    import json

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = ITEM.format(doc_id=f"doc_id {kind}")

    def cut(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = encoder(tokenizer_path(name)).encode, np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 200):
                rows = [[] for _ in range(7)]
                for d, b in zip(ids[at : at + 200], encode(texts.slice(at, 200).to_pylist()), strict=True):
                    b += end
                    n = len(b) // 4
                    for start in range(0, n, capacity):
                        piece = b[4 * start : 4 * (start + capacity)]
                        k = len(piece) // 4
                        small = None if k == capacity else np.frombuffer(piece, "<u4").astype("<u2" if narrow else "<u4").tobytes()
                        for column, value in zip(rows, (uid, d, start, k, zlib.crc32(piece), n, small), strict=True):
                            column.append(value)
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    types = [pa.int64(), to_arrow_type(docs.schema[doc_id].dataType), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    with open(tokenizer_path(name)) as f:
        model = json.load(f)
    narrow = max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]) < 1 << 16
    made = docs.select(doc_id, text_of(text).alias("text")).mapInArrow(cut, schema)
    unit = F.ceil(F.col("length") / GRID).cast("int")
    out = made.withColumn("unit", F.when(F.col("length") == capacity, capacity // GRID + 1).otherwise(unit)).withColumn("draw", F.xxhash64("doc_id", "start", "ids_crc32"))
    return materialize(out, "pack-items").withColumn("wide", F.lit(not narrow))


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` within ``room``: value, counts."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = np.searchsorted(sizes, c, side="right")
        if fit:
            v = best[c - sizes[:fit]] + values[:fit]
            j = int(v.argmax())
            if v[j] > best[c] + 1e-12:
                best[c], pick[c] = v[j], j
    counts, c = np.zeros(len(sizes), dtype=np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts a size) and how often to use each (fractional).

    Revised simplex over the covering program; every basis is feasible, so
    stopping after ``rounds`` still covers the demand.
    """
    m = len(sizes)
    columns = np.diag((room // sizes).astype(float))  # one column a basis row
    cost, inverse = np.ones(m), np.diag(1.0 / (room // sizes))
    x = inverse @ demand.astype(float)
    for _ in range(rounds):
        duals = cost @ inverse
        low = int(duals.argmin())
        if duals[low] < -1e-9:  # a surplus column: more of a size than asked for
            column, price = np.zeros(m), 0.0
            column[low] = -1
        else:
            value, counts = knapsack(np.maximum(duals, 0), sizes, room)
            if value <= 1 + 1e-7:
                break
            column, price = counts.astype(float), 1.0
        u = inverse @ column
        ratio = np.where(u > 1e-9, np.maximum(x, 0) / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        x = x - ratio[r] * u
        x[r] = ratio[r]
        row = inverse[r] / u[r]
        inverse -= np.outer(u, row)
        inverse[r] = row
        columns[:, r], cost[r] = column, price
    used = cost > 0
    return columns.T[used].astype(np.int64), np.maximum(x[used], 0)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Rounded patterns ({unit: copies}, times) and how many items of each
    unit they take. Takes fewer until what is left can fill their room."""
    room = capacity // GRID
    count, tokens = {}, {}
    for length, n in histogram.items():
        if length < capacity:
            u = -(-length // GRID)
            count[u], tokens[u] = count.get(u, 0) + n, tokens.get(u, 0) + n * length
    if not count:
        return [], {}
    sizes = np.array(sorted(count))
    demand = np.array([count[u] for u in sizes])
    mean = np.array([tokens[u] for u in sizes]) / demand
    patterns, times = cutting_stock(sizes, demand, room)
    order = np.lexsort(patterns.T)
    patterns, times = patterns[order], times[order]
    for less in range(0, 1001, 2):
        t = np.floor(times * (1 - less / 1000) + 1e-9).astype(np.int64)
        taken = np.minimum(t @ patterns, demand)
        # surplus columns may make patterns ask for more items than there are
        while (t @ patterns > demand).any():
            over = np.flatnonzero(t @ patterns > demand)[0]
            t[np.argmax(t * (patterns[:, over] > 0))] -= 1
            taken = t @ patterns
        slack, rest = capacity * t.sum() - taken @ mean, (demand - taken) @ mean
        if rest >= 1.01 * slack + 4 * capacity or not t.sum():
            break
    else:
        t = t * 0
    taken = t @ patterns
    kept = [({int(s): int(a) for s, a in zip(sizes, p, strict=True) if a}, int(k)) for p, k in zip(patterns, t, strict=True) if k]
    return kept, {int(s): int(k) for s, k in zip(sizes, taken, strict=True)}


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(unit, first rank, end rank, copies a sequence, first sequence, slot)."""
    out, used, first = [], {}, 0
    for pattern, times in patterns:
        slot = 0
        for unit, copies in sorted(pattern.items(), reverse=True):
            at = used.get(unit, 0)
            out.append((unit, at, at + times * copies, copies, first, slot))
            used[unit], slot = at + times * copies, slot + copies
        first += times
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    all_items = items(docs, doc_id, text, capacity, end_id, tokenizer)
    histogram = dict(all_items.groupBy("length").count().collect())  # at most ``capacity`` rows
    patterns, taken = plan(histogram, capacity)
    per_unit: dict[int, int] = {}
    for length, n in histogram.items():
        u = capacity // GRID + 1 if length == capacity else -(-length // GRID)
        per_unit[u] = per_unit.get(u, 0) + n
    first_rank, at = {}, 0
    for u in sorted(per_unit):
        first_rank[u], at = at, at + per_unit[u]
    blocks, whole = per_unit.get(capacity // GRID + 1, 0), sum(k for _, k in patterns)
    table = slots(patterns)
    if blocks:  # each is a sequence of its own
        table.append((capacity // GRID + 1, 0, blocks, 1, whole, 0))
    ranked = ordered_rows(all_items.drop("ids", "wide"), [F.col("unit"), F.col("draw"), F.col("doc_id"), F.col("start"), F.col("uid")], "pack-ranks")
    bounds = {u: sorted((lo, hi, c, s, k) for v, lo, hi, c, s, k in table if v == u) for u in per_unit}
    names = ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "unit", "draw"]

    def place(batches):  # the table has a few thousand rows at most: patterns times their lengths
        import pyarrow as pa

        arrays = {u: np.array(b, dtype=np.int64).reshape(-1, 5) for u, b in bounds.items()}
        for batch in batches:
            unit = batch.column(names.index("unit")).to_numpy()
            rank = batch.column(len(names)).to_numpy().copy()
            sequence, slot = np.full(len(unit), -1, np.int64), np.zeros(len(unit), np.int64)
            for u in np.unique(unit):
                mine = np.flatnonzero(unit == u)
                r = rank[mine] - first_rank[u]
                rank[mine] = r
                b = arrays[u]
                if len(b):
                    k = np.searchsorted(b[:, 1], r, side="right")
                    fits = k < len(b)
                    mine, r, k = mine[fits], r[fits], k[fits]
                    sequence[mine] = b[k, 3] + (r - b[k, 0]) // b[k, 2]
                    slot[mine] = b[k, 4] + (r - b[k, 0]) % b[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rank), pa.array(sequence), pa.array(slot)], names=[*names, "unit_rank", "sequence_id", "slot"])

    fields = ranked.select(*names).schema
    for c in ("unit_rank", "sequence_id", "slot"):
        fields = fields.add(c, "long")
    placed = materialize(ranked.select(*names, "row_rank").mapInArrow(place, fields), "pack-placed")
    side = Window.partitionBy("sequence_id").orderBy("slot")  # at most capacity / GRID slots
    seated = placed.where("sequence_id >= 0").withColumn("offset", F.sum("length").over(side) - F.col("length"))
    seated = seated.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    filler = placed.where("sequence_id < 0")
    stream = ordered_rows(filler.select("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "unit", "draw"), [F.col("unit"), F.col("draw"), F.col("uid")], "pack-stream", "length")
    total = filler.agg(F.sum("length")).first()[0] or 0
    if not total:
        return seated
    room = placed.where(f"sequence_id >= 0 AND sequence_id < {whole}").groupBy("sequence_id").agg(F.sum("length").alias("used"))
    room = room.where(F.col("used") < capacity).withColumn("free", F.lit(capacity) - F.col("used"))
    room = ordered_rows(room, [F.col("sequence_id")], "pack-room", "free").select("sequence_id", "used", "free", F.col("row_before").alias("at"))
    free = room.agg(F.sum("free")).first()[0] or 0
    over = max(0, total - free)
    full, rest = divmod(over, capacity)
    more = spark.range(full).select((F.col("id") + whole + blocks).alias("sequence_id"), F.lit(0).cast("long").alias("used"), F.lit(capacity).cast("long").alias("free"), (F.col("id") * capacity + free).alias("at"))
    tail, at = [], free + full * capacity
    for bit in reversed(range(capacity.bit_length())):
        if rest >> bit & 1:
            tail.append((whole + blocks + full + len(tail), 0, 1 << bit, at))
            at += 1 << bit
    room = room.unionByName(more).unionByName(spark.createDataFrame(tail, "sequence_id long, used long, free long, at long"))

    width = 4 * capacity
    spread = lambda df, at, n: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(at) / width), F.floor((F.col(at) + F.col(n) - 1) / width))))
    a, b = spread(stream.withColumnRenamed("row_before", "a_at"), "a_at", "length"), spread(room, "at", "free")
    lo, hi = F.greatest("a_at", "at"), F.least(F.col("a_at") + F.col("length"), F.col("at") + F.col("free"))
    met = a.join(b, "bucket").where((lo < hi) & (F.floor(lo / width) == F.col("bucket")))
    parts = met.select("uid", "doc_id", (F.col("start") + lo - F.col("a_at")).alias("start"), (lo - F.col("a_at")).alias("skip"), (hi - lo).alias("length"), "doc_tokens", "sequence_id", (F.col("used") + lo - F.col("at")).alias("offset"))

    # the fillers' ids: those past the last seated draw of their unit (a row a unit at most)
    last = placed.where("sequence_id >= 0").groupBy("unit").agg(F.max("draw").alias("last_draw"))
    ids = all_items.join(F.broadcast(last), "unit", "left").where("ids IS NOT NULL AND (last_draw IS NULL OR draw >= last_draw)").select("uid", "ids", "wide")
    names = seated.columns
    both = parts.join(ids, "uid").select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "skip", "ids", "wide")

    def checksum(batches, names=names):
        import zlib

        import pyarrow as pa

        for batch in batches:
            skip, length = batch.column(6).to_pylist(), batch.column(2).to_pylist()
            crc = []
            for i, (s, n) in enumerate(zip(skip, length, strict=True)):
                kind = "<u4" if batch.column(8)[i].as_py() else "<u2"
                crc.append(zlib.crc32(np.frombuffer(batch.column(7)[i].as_py(), kind)[s : s + n].astype("<u4").tobytes()))
            c = batch.columns
            yield pa.RecordBatch.from_arrays([c[0], c[1], c[2], pa.array(crc, pa.int64()), *c[3:6]], names=names)

    return seated.unionByName(both.mapInArrow(checksum, seated.schema))
