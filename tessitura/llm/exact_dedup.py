"""Exact deduplication on a sharded cuckoo-filter index with insertion and deletion of live digests.

A text's key is the SHA-256 of its normal form (runs of white space become one space; null counts as empty). Keys are
dealt over shards by their leading bits. A shard's filter has buckets of four 16-bit tags, two candidate buckets for each
key; beside each tag, in the same bucket, lies what it stands for: the full digest, the byte length, the smallest id and
the count. The filter answers first: where neither bucket has the tag, the key is new for certain. A hit is verified
against the content of its bucket, so a false positive costs one comparison and never a row. Content moves with its tag.
When an insertion finds no place after ``KICKS`` moves the table is doubled and rebuilt from the stored keys. Deletion
lowers the count and takes tag and content out when the key has gone.

Scale: only (digest, length, id, count) move, folded per Arrow batch before the shuffle, so a text held by a third of
all rows sends one row per batch to its shard, and meets its answer by broadcast (``skew_join``). A shard holds about
``SHARD_KEYS`` keys at most: shards follow the number of rows, and aren't merged. Texts are read twice. Dropped rows are
found by id and digest; up to 100,000 of them are broadcast, so no text moves, beyond that the join deals texts by both,
so that copies of one text spread.

Defined cases: null, empty and blank texts: null and '' are equal, blanks equal ' '; a null id never stays before a
non-null id; equal ids on equal texts: all those rows stay (they cannot be told apart); an empty table gives an empty
result; other columns are kept by ``drop_copies``, whatever their names, and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, settle, skew_join, small, tidy

SLOTS, KICKS, LOAD, SHARD_KEYS = 4, 200, 0.9, 500_000


class LiveIndex:
    """One shard. tags[b][s] is the tag in slot s of bucket b, held[b][s] its content: [digest, bytes, smallest id, count]."""

    def __init__(self, buckets: int = 64):
        self.hits = self.false_hits = self.resizes = 0
        self._clear(1 << max(1, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.n, self.size = buckets, 0
        self.tags: list[list[int]] = [[] for _ in range(buckets)]
        self.held: list[list[list]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "big")
        first = int.from_bytes(digest[:8], "big") & self.n - 1
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag + 1) * 0x5BD1E995) & self.n - 1

    def may_hold(self, digest: bytes) -> bool:
        """The filter's answer: False is certain."""
        tag, a, b = self._places(digest)
        return tag in self.tags[a] or tag in self.tags[b]

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        """(bucket, slot) of a live key: tags first, then the content beside those that fit."""
        tag, a, b = self._places(digest)
        for bucket in (a, b) if a != b else (a,):
            if tag not in self.tags[bucket]:
                continue
            for slot, t in enumerate(self.tags[bucket]):
                if t == tag:
                    self.hits += 1
                    if self.held[bucket][slot][0] == digest:
                        return bucket, slot
                    self.false_hits += 1
        return None

    def add(self, digest: bytes, n_bytes: int, smallest: int | None, count: int = 1) -> None:
        at = self._find(digest)
        if at is None:
            self._insert([digest, n_bytes, smallest, count])
            return
        entry = self.held[at[0]][at[1]]
        if entry[1] != n_bytes:
            raise ValueError("one digest for texts of two lengths")
        if smallest is not None:
            entry[2] = smallest if entry[2] is None else min(entry[2], smallest)
        entry[3] += count

    def _insert(self, entry: list) -> None:
        homeless = self._place(entry)
        if homeless is None:
            return
        stored, buckets = [*self.entries(), homeless], self.n
        while True:  # overflow: twice the buckets, filled again from the stored keys
            self.resizes += 1
            buckets *= 2
            self._clear(buckets)
            if all(self._place(e) is None for e in stored):
                return

    def _place(self, entry: list) -> list | None:
        """Put an entry into one of its buckets, moving others to their second; the entry left without a place, or None."""
        if self.size >= LOAD * SLOTS * self.n:
            return entry
        tag, a, b = self._places(entry[0])
        self.size += 1
        bucket = a if len(self.tags[a]) < SLOTS else b
        for turn in range(KICKS):
            if len(self.tags[bucket]) < SLOTS:
                self.tags[bucket].append(tag)
                self.held[bucket].append(entry)
                return None
            slot = turn % SLOTS
            self.tags[bucket][slot], tag = tag, self.tags[bucket][slot]
            self.held[bucket][slot], entry = entry, self.held[bucket][slot]
            bucket = self._other(bucket, tag)
        self.size -= 1
        return entry

    def remove(self, digest: bytes, count: int = 1) -> bool:
        """Take ``count`` copies out; False if the key isn't live."""
        at = self._find(digest)
        if at is None:
            return False
        bucket, slot = at
        self.held[bucket][slot][3] -= count
        if self.held[bucket][slot][3] <= 0:
            del self.held[bucket][slot], self.tags[bucket][slot]
            self.size -= 1
        return True

    def entries(self) -> Iterator[list]:
        for bucket in self.held:
            yield from bucket


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


_KEY = "digest binary, n_bytes long, keep_id long, n long, op int"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch one row for each (op, digest): what a map-side combine would do."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["digest", "op"]).aggregate([("n_bytes", "max"), ("id", "min"), ([], "count_all")])
        out = pa.table({"digest": t["digest"], "n_bytes": t["n_bytes_max"], "keep_id": t["id_min"], "n": t["count_all"], "op": t["op"]})
        yield from out.combine_chunks().to_batches()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's shard of the index: insertions first, then deletions; emits what is live."""
    shard, gone = LiveIndex(), []
    for batch in batches:
        for d, n_bytes, smallest, n, op in zip(*(batch[c].to_pylist() for c in ("digest", "n_bytes", "keep_id", "n", "op")), strict=True):
            if op > 0:
                shard.add(d, n_bytes, smallest, n)
            else:
                gone.append((d, n))
    for d, n in gone:
        shard.remove(d, n)
    live = list(shard.entries())
    for i in range(0, len(live), 20_000):
        d, n_bytes, smallest, n = zip(*live[i : i + 20_000], strict=True)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(d, pa.binary()), "keep_id": pa.array(smallest, pa.int64()), "group_size": pa.array(n, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64())})


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normal(text), 256))


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_bytes) of every row; settled, so texts are read and hashed once."""
    text = F.col(text_col)
    return settle(docs.select(F.col(id_col).cast("long").alias("id"), digest_of(text).alias("digest"), F.octet_length(normal(text)).cast("long").alias("n_bytes")), "digests")


def live_groups(inserted: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(digest, keep_id, group_size, n_bytes) of every live key after insertions and deletions of (id, digest, n_bytes).

    A deletion takes one copy out of its group; the smallest id of the group stays what it was until the key has gone.
    """
    ops = inserted.select("id", "digest", "n_bytes", F.lit(1).alias("op"))
    if deleted is not None:
        ops = ops.unionByName(deleted.select("id", "digest", "n_bytes", F.lit(-1).alias("op")))
    shards = max(int(inserted.sparkSession.conf.get("spark.sql.shuffle.partitions")), inserted.count() // SHARD_KEYS + 1)
    lead = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    dealt = ops.mapInArrow(tidy(_fold), _KEY).withColumn("_shard", F.pmod(lead, F.lit(shards)).cast("int")).repartitionById(shards, F.col("_shard"))
    return dealt.drop("_shard").mapInArrow(tidy(_index), "digest binary, keep_id long, group_size long, n_bytes long")


def _answered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, id, n_bytes, keep_id, group_size) of every row."""
    keyed = keys(docs, id_col, text_col)
    groups = settle(live_groups(keyed), "groups")
    return skew_join(keyed, groups.select("digest", "keep_id", "group_size"), "digest", "inner")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _answered(docs, id_col, text_col).select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each text: all columns."""
    met = _answered(docs, id_col, text_col)
    gone = settle(met.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest").distinct(), "gone")
    gone = small(gone.toDF("_gone_id", "_gone_digest"))
    same = docs[id_col].cast("long").eqNullSafe(gone["_gone_id"]) & (digest_of(docs[text_col]) == gone["_gone_digest"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)
