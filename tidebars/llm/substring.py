"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

A word goes when a window of `width` words that covers it also starts in a document with a smaller doc_id. A shard
is a bounded number of words of reference documents; its generalised suffix automaton, over words, knows for every
state the smallest document it occurs in. A document is streamed through it; wherever the matching statistic reaches
the width, the state of the last `width` words tells whether a smaller document has them. Runs of such windows are
the maximal spans that are removed.

The corpus is its own reference, so shards grow with it: neither broadcasting all of them nor streaming every
document through each can work at scale. What is broadcast to a document is instead what can concern it. A sweep
over window hashes, sent to the partition of the hash in packed runs, names for every window of more than one document
the smallest one; a document asks for those documents alone, and meets them in the shards they fall into.
A shard asked for by very many documents is built again for every few hundred of them. The sweep only routes: what is
removed the automaton alone decides, by the sequence of its words, each as a 64-bit hash.

Defined results: a null or short text loses nothing; a null doc_id neither loses nor serves as reference; rows that
repeat a doc_id are one document as references and are cleaned row by row; an empty table gives no rows;
columns other than doc_id and text are left alone, whatever their names (clean() puts its measures in the place of
columns that have their names; deduplicated() adds none).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidebars.llm.arrow_text import U64, chunks, mix, ngram_hashes, word_bounds, word_hashes
from tidebars.llm.store import REST, aside, materialize, restored, shuffle_partitions, small_batches

WIDTH = 13
#: Windows handled at a time by a task that sends them.
RUN_WINDOWS = 500_000
#: Windows that a task sweeps at most, about, and characters of a word with its space.
WINDOWS, WORD_CHARS = 2_000_000, 6
#: Words of an automaton, and documents that share one copy of a shard.
SHARD_WORDS, STREAMED = 60_000, 500


class SuffixAutomaton:
    """All substrings of several sequences; first: per state, the smallest owner of a sequence that has it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 63]

    def _state(self, length: int, link: int, edges: dict[int, int], first: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the substrings of q no longer than those of p and c."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 1 << 63)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int], owner: int) -> None:
        last = 0
        following, link, length = self.next, self.link, self.length
        for c in sequence:
            q = following[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
            else:
                new = self._state(length[last] + 1, 0, {}, 1 << 63)
                p = last
                while p != -1 and c not in following[p]:
                    following[p][c] = new
                    p = link[p]
                if p != -1:
                    q = following[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = new
            if owner < self.first[last]:
                self.first[last] = owner

    def finish(self) -> None:
        """Hand owners down to the suffixes, longest first."""
        first, link = self.first, self.link
        for s in np.argsort(-np.array(self.length), kind="stable").tolist():
            p = link[s]
            if p > 0 and first[s] < first[p]:
                first[p] = first[s]

    def ends(self, sequence: list[int], width: int, before: int) -> list[int]:
        """Positions at which the last width elements occur in a sequence of an owner below before."""
        out: list[int] = []
        following, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for i, c in enumerate(sequence):
            to = following[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = following[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= width:
                # longer matches tell nothing more: stay with the state of the last width elements
                while length[link[state]] >= width:
                    state = link[state]
                    matched = length[state]
                if first[state] < before:
                    out.append(i)
        return out


def _send(docs: DataFrame, parts: int, width: int) -> DataFrame:
    """part, own, counts, hashes: window hashes by partition; with own null, pairs (counts: documents, hashes: smaller ones) found at once."""

    def run(batches):
        held: list[np.ndarray] = []
        owners: list[int] = []
        windows = turn = 0

        def flush():
            nonlocal turn
            hashes, own = np.concatenate(held), np.repeat(np.array(owners, np.int64), [len(h) for h in held])
            order = np.lexsort((own, hashes))
            hashes, own = hashes[order], own[order]
            first = np.append(True, hashes[1:] != hashes[:-1])
            least = own[np.flatnonzero(first)[np.cumsum(first) - 1]]
            again = own != least
            rows: list[tuple] = []
            if again.any():
                pairs = np.unique(np.stack([own[again], least[again]]), axis=1)
                rows.append((turn % parts, None, pairs[0].tobytes(), pairs[1].tobytes()))
                turn += 1
            hashes, own = hashes[first], own[first]
            part = (mix(hashes) % U64(parts)).astype(np.int64)
            order = np.lexsort((own, part))
            part, hashes, own = part[order], hashes[order], own[order]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True):
                start = np.flatnonzero(np.append(True, own[a + 1 : b] != own[a : b - 1]))
                rows.append((int(part[a]), own[a:b][start].tobytes(), np.diff(np.append(start, b - a)).astype(np.uint32).tobytes(), hashes[a:b].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["part", "own", "counts", "hashes"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, data, at in chunks(batch.column(1)):
                starts, ends, before = word_bounds(data, at)
                grams = ngram_hashes(word_hashes(data, starts, ends), width)
                for i in range(hi - lo):
                    n = int(before[i + 1] - before[i]) - width + 1
                    if n > 0:
                        held.append(grams[before[i] : before[i] + n])
                        owners.append(doc_ids[lo + i])
                        windows += n
                if windows >= RUN_WINDOWS:
                    yield flush()
                    held, owners, windows = [], [], 0
        if held:
            yield flush()

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, own binary, counts binary, hashes binary")


def requests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, ref: for every window that starts in a smaller document too, some such document."""
    # parts grow with the corpus, so that a task's windows stay within WINDOWS
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), chars // WORD_CHARS // WINDOWS)

    def run(batches):
        hashes, own, found = [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                values = batch.column(3)[i].as_py()
                if not batch.column(1)[i].is_valid:
                    found.append(np.stack([np.frombuffer(batch.column(2)[i].as_py(), np.int64), np.frombuffer(values, np.int64)]))
                    continue
                hashes.append(np.frombuffer(values, np.uint64))
                own.append(np.repeat(np.frombuffer(batch.column(1)[i].as_py(), np.int64), np.frombuffer(batch.column(2)[i].as_py(), np.uint32)))
        if hashes:
            h, o = np.concatenate(hashes), np.concatenate(own)
            del hashes, own
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order]
            first = np.append(True, h[1:] != h[:-1])
            least = np.minimum.reduceat(o, np.flatnonzero(first))[np.cumsum(first) - 1]
            again = o != least
            if again.any():
                found.append(np.stack([o[again], least[again]]))
        if found:
            # a pair turns up in many parts: pairs leave packed, by document, and are made distinct where they arrive
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            to = (mix(pairs[0].astype(np.uint64)) % U64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, pairs = to[order], pairs[:, order]
            at = np.flatnonzero(np.diff(to, prepend=-1))
            rows = [(int(to[x]), pairs[0, x:y].tobytes(), pairs[1, x:y].tobytes()) for x, y in zip(at.tolist(), [*at[1:].tolist(), len(to)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["part", "docs", "refs"])

    def distinct(batches):
        found = []
        for batch in batches:
            for docs_, refs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(np.stack([np.frombuffer(docs_, np.int64), np.frombuffer(refs, np.int64)]))
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            for lo in range(0, pairs.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0, lo : lo + 100_000]), pa.array(pairs[1, lo : lo + 100_000])], names=["doc_id", "ref"])

    sent = _send(docs, parts, width).repartitionById(parts, F.col("part"))
    pairs = sent.mapInArrow(run, "part int, docs binary, refs binary").repartitionById(parts, F.col("part"))
    return pairs.mapInArrow(distinct, "doc_id long, ref long")


def _words(text: pa.Array) -> Iterator[list[int]]:
    """Words of each text as integers."""
    for lo, hi, data, at in chunks(text):
        starts, ends, before = word_bounds(data, at)
        own = word_hashes(data, starts, ends).tolist()
        for i in range(hi - lo):
            yield own[before[i] : before[i + 1]]


def _spans(ends: list[int], width: int) -> np.ndarray:
    """Starts and ends, flat, of the union of the windows that end there."""
    e = np.array(ends, np.int64)
    new = np.append(True, np.diff(e) > width)
    last = np.append(new[1:], True)
    return np.stack([e[new] - width + 1, e[last] + 1], axis=1).ravel()


def spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h (hash of the text), spans: lists of word positions (start, end, start, end ...) to be removed."""
    asked = materialize(requests(docs, width), "requests")
    n_refs = asked.select("ref").distinct().count()
    n_words = docs.agg(F.avg(F.length("text"))).first()[0] or 0.0
    shards = max(1, int(n_refs * n_words / WORD_CHARS / SHARD_WORDS))
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("ref"), F.lit(shards)))
    streams = asked.select("shard", "doc_id").distinct()
    copies = streams.groupBy("shard").agg(F.ceil(F.count("*") / STREAMED).cast("int").alias("copies"))
    streams = streams.join(copies, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "doc_id")
    refs = asked.select("shard", F.col("ref").alias("doc_id")).distinct().join(copies, "shard")
    refs = refs.select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "doc_id")
    roles = materialize(streams.union(refs), "shards")

    def run(table: pa.Table) -> pa.Table:
        kind, own, h = (table.column(c).to_numpy() for c in ("kind", "doc_id", "h"))
        words = list(_words(table.column("text").combine_chunks()))
        pieces = [(int(own[i]), words[i][a : a + SHARD_WORDS]) for i in np.flatnonzero(kind == 0).tolist() for a in range(0, max(1, len(words[i]) - width + 1), SHARD_WORDS - width + 1)]
        found: dict[int, list[int]] = {}
        while pieces:
            automaton, held = SuffixAutomaton(), 0
            while pieces and (not held or held + len(pieces[-1][1]) <= SHARD_WORDS):
                owner, sequence = pieces.pop()
                automaton.add(sequence, owner)
                held += len(sequence)
            automaton.finish()
            for i in np.flatnonzero(kind == 1).tolist():
                ends = automaton.ends(words[i], width, int(own[i]))
                if ends:
                    found.setdefault(i, []).extend(ends)
        at = sorted(found)
        lists = [_spans(sorted(set(found[i])), width) for i in at]
        return pa.table({"doc_id": pa.array(own[at], pa.int64()), "h": pa.array(h[at], pa.int64()), "spans": pa.array(lists, pa.list_(pa.int64()))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # both sides grow with the corpus: merged at any size, never broadcast
    rows = roles.hint("merge").join(texts, "doc_id").select("shard", "copy", "kind", "doc_id", "h", "text")
    found = rows.groupBy("shard", "copy").applyInArrow(run, "doc_id long, h long, spans array<long>")
    return materialize(found.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


MEASURES = ("n_words", "n_removed", "kept_sha256")


def _cleaned(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text (kept words with one space between), the other columns in one, and the measures."""
    small_batches(docs.sparkSession)
    removed = spans(docs, width).withColumnsRenamed({"doc_id": "owner"})
    rows = aside(docs, ("doc_id", "text")).withColumn("text", F.col("text").cast("string"))
    rows = rows.join(removed.hint("merge"), (F.col("doc_id") == F.col("owner")) & (F.xxhash64("text") == F.col("h")), "left").select("doc_id", F.col(f"`{REST}`"), "text", "spans")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept = words
                if cut:
                    keep = np.ones(len(words), bool)
                    for a, b in zip(cut[0::2], cut[1::2], strict=True):
                        keep[a:b] = False
                    kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                joined = b" ".join(kept)
                for column, value in zip(out, (joined.decode(), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()), strict=True):
                    column.append(value)
            arrays = [*batch.columns[:2], *(pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", REST, "text", *MEASURES])

    kinds = (StringType(), LongType(), LongType(), StringType())
    added = [StructField(n, t) for n, t in zip(("text", *MEASURES), kinds, strict=True)]
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], rows.schema[REST], *added]))


def clean(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every row with its columns, text being its kept words with one space between; then n_words, n_removed, kept_sha256."""
    return restored(_cleaned(docs, width), docs, ("doc_id", "text"), MEASURES)


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns of docs with cleaned texts; rows that lost all their words go."""
    return restored(_cleaned(docs, width).where("n_words > n_removed OR n_removed = 0"), docs, ("doc_id", "text"))


def report(docs: DataFrame) -> DataFrame:
    return clean(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
