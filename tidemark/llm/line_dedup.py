"""Line dedup by MinHash: of all lines that are alike, one stays.

A line is compared after lower-casing A-Z and stripping white space at its ends. Its set: the distinct runs of SHINGLE
characters, or the whole line if it is shorter. Signatures are one-permutation MinHash with BANDS * ROWS bins, empty bins
filled from others by a fixed permutation; lines that agree in all ROWS bins of a band are candidates, verified by exact Jaccard.
With 20 bands of 6 rows two lines of similarity 0.8 are candidates with probability 0.998.

Each block of documents sends the band keys and the names of its distinct lines, sorted and packed, to buckets,
with the lines themselves, compressed, kept by the block. A bucket answers what different lines share: equal lines get the
address of the first of them, which is their node; lines with equal band keys get the first node that has that key, their centre. Every
node is compared with its few centres; only keys whose lines that leaves in several components make an index for ``cluster``, which compares the rest exactly.
Lines are named by the 128-bit hash of what is compared (of the set, if that is tiny); in a band they are told apart by 16 bits that differ
from band to band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.clusters import cluster, labelled
from tidemark.llm.common import Scratch, fresh, sliced, trimmed
from tidemark.llm.components import connected_components
from tidemark.llm.exchange import BLOCK_BYTES, KINDS, NAMES, SENT, Form, exchanged, pack, place_of, planned, unpack
from tidemark.llm.shingle_join import BITS, differing, mix

SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 20, 6
#: A set of no more shingles is named by itself.
FEW = 3
#: Bytes that a key takes in a broadcast.
ENTRY_BYTES = 96
EMPTY, KEY = np.uint32(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFF0000)
#: Characters and lines that are hashed at once: arrays of that size stay in a CPU's cache.
PIECE, GROUP = 1 << 16, 2048
#: Bits of an address for the line's place in its block, and for the block's number in its partition.
PLACE_BITS, BLOCK_BITS = 24, 16


def norms(text: bytes | None) -> list[bytes]:
    """What is compared of each line; empty for a blank line."""
    return [x.strip() for x in (text or b"").lower().split(b"\n")]


def named(line: bytes) -> bytes:
    """The hash that names a line. With FEW shingles or less it is that of the set: such a set has no partner of similarity 0.8 but its equal."""
    text = line if line.isascii() else line.decode("utf-8", "replace")
    # Of the first FEW + 1 shingles two are equal then, so the last character of the first overlap comes again.
    if len(text) < SHINGLE + FEW or text[FEW] in text[FEW + 1 : 2 * FEW + 1] and len({text[i : i + SHINGLE] for i in range(FEW + 1)}) <= FEW:
        own = shingles(line.decode("utf-8", "replace"))
        if len(own) <= FEW:
            return xxhash.xxh3_128_digest("\n".join(sorted(own)).encode())
    return xxhash.xxh3_128_digest(line)


def pieces(lines: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The lines, with their places, in lists of about PIECE characters. A longer line comes in parts that share SHINGLE - 1 characters."""
    places, held, size = [], [], 0
    for k, line in enumerate(lines):
        parts = (line,) if len(line) <= PIECE else (line[at : at + PIECE + SHINGLE - 1] for at in range(0, len(line) - SHINGLE + 1, PIECE))
        for part in parts:
            if len(part) < SHINGLE:
                part += "\0" * (SHINGLE - len(part))
            if size + len(part) > PIECE and held:
                yield np.array(places), held
                places, held, size = [], [], 0
            places.append(k)
            held.append(part)
            size += len(part)
    if held:
        yield np.array(places), held


def hashed(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hash of each shingle, with the place of its line, piece by piece."""
    for places, part in pieces(lines):
        size = np.array([len(x) for x in part], np.int64)
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(code) - SHINGLE + 1
        h = code[:n].copy()
        for i in range(1, SHINGLE):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += code[i : n + i]
        # The last characters of a line begin no shingle.
        full = np.ones(len(code), bool)
        ends = np.cumsum(size)
        for i in range(1, SHINGLE):
            full[ends - i] = False
        yield mix(h[full[:n]]), np.repeat(places, size - SHINGLE + 1)


def distinct(lines: list[str]) -> Iterator[np.ndarray]:
    """The shingles of at most 65,536 lines, each once: the line's place in 16 bits, 48 bits of the hash, in order."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for h, owner in hashed(lines):
        if held and owner[0] != held[-1][1][-1]:
            yield _once(held)
            held = []
        held.append((h, owner))
    if held:
        yield _once(held)


def _once(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    own = np.sort(np.concatenate([owner.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16) for h, owner in parts]))
    return own[np.append(True, own[1:] != own[:-1])]


def described(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The size of each line's set, and BITS bits, each the parity of the shingles that hash to it."""
    sizes, odd = np.zeros(len(lines), np.int32), np.zeros(len(lines) * BITS, np.int64)
    for own in distinct(lines):
        owner = (own >> np.uint64(48)).astype(np.int64)
        sizes += np.bincount(owner, minlength=len(lines)).astype(np.int32)
        odd += np.bincount(owner * BITS + (own % np.uint64(BITS)).astype(np.int64), minlength=len(lines) * BITS)
    return sizes, np.packbits((odd % 2).astype(np.uint8).reshape(len(lines), BITS), axis=1).view(np.int64).reshape(len(lines), BITS // 64)


def band_keys(lines: list[str]) -> np.ndarray:
    """For each line its BANDS keys, as rows of a matrix of 64-bit integers."""
    bins = BANDS * ROWS
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for at in range(0, len(lines), GROUP):
        part = lines[at : at + GROUP]
        least = np.full(len(part) * bins, EMPTY, np.uint32)
        for h, owner in hashed(part):
            place = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(least, owner * bins + place, (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
        least = least.reshape(len(part), bins)
        rng, out = np.random.default_rng(5), least.copy()
        open_ = np.flatnonzero((least == EMPTY).any(axis=1))
        rows = given = least[open_]
        while len(open_):
            donor = given[:, rng.integers(0, bins, bins)]
            rows = np.where(rows == EMPTY, donor, rows)
            left = (rows == EMPTY).any(axis=1)
            out[open_[~left]] = rows[~left]
            open_, rows, given = open_[left], rows[left], given[left]
        own = np.zeros((len(part), BANDS), np.uint64)
        for r in range(ROWS):
            own = mix(own + out[:, r * BANDS : (r + 1) * BANDS])
        keys[at : at + GROUP] = mix(own + np.arange(BANDS, dtype=np.uint64))
    # Bits that would not make two keys differ in any corpus only take room.
    return keys & KEY


def _send(buckets: int):
    """Per block a row of its distinct lines, where they stand (ids: those of its documents, then the hashes of their texts, then whether an earlier
    block has their first lines) and what they are; for each bucket the band keys of its lines (even numbers) or their names (odd numbers)."""

    def cut(token: np.ndarray) -> np.ndarray:
        return np.searchsorted(place_of(token, buckets), np.arange(buckets + 1, dtype=np.uint64)).tolist()

    def block(key: int, ids: list, place: dict[bytes, int], at: list[tuple[int, int, int]]) -> Iterator[tuple]:
        names = [named(x) for x in place]
        yield key, -1 - key % (1 << 30), ids, b"".join(names), pack(np.array(at, np.int32).reshape(-1, 3).T.ravel()), zstandard.ZstdCompressor(level=3).compress(b"\n".join(place))
        both = np.frombuffer(b"".join(names), ">u8").astype(np.uint64).reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        high, low = both[order, 0], both[order, 1]
        ends = cut(high)
        for b, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if lo < hi:
                yield key, 2 * b + 1, None, pack(high[lo:hi]), pack(order[lo:hi].astype(np.int32)), pack(low[lo:hi])
        # Sets of up to FEW shingles are equal by their names.
        own = [(i, x) for x, i in place.items() if len(x) >= SHINGLE + FEW]
        if not own:
            return
        token = band_keys([x.decode("utf-8", "replace") for _, x in own]).ravel()
        owner = np.repeat(np.array([i for i, _ in own], np.int32), BANDS)
        mark = (mix(both[owner, 0] + token) >> np.uint64(48)).astype(np.uint16)
        order = np.argsort(token, kind="stable")
        token, owner, mark = token[order], owner[order], mark[order]
        ends = cut(token)
        for b, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if lo < hi:
                yield key, 2 * b, None, pack(token[lo:hi]), pack(owner[lo:hi]), pack(mark[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, ids, bodies, later, place, at, size = TaskContext.get().partitionId(), 0, [], [], [], {}, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, bodies, later, place, at, size
            if number >> BLOCK_BITS or len(place) >> PLACE_BITS:
                raise ValueError("a partition has too much text: read the table in more partitions")
            rows = list(block(part << BLOCK_BITS | number, ids + bodies + later, place, at)) if place else []
            number, ids, bodies, later, place, at, size = number + 1, [], [], [], {}, [], 0
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(KINDS)], names=NAMES)

        for batch in sliced(batches, 1):
            for doc, text, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new, more = True, 0
                for k, line in enumerate(norms(text)):
                    if not line:
                        continue
                    if new:
                        ids.append(doc)
                        bodies.append(body)
                        later.append(more)
                        new, more = False, 1
                    at.append((len(ids) - 1, k, place.setdefault(line, len(place))))
                    size += len(line) + 1
                    if size >= BLOCK_BYTES:
                        yield flush()
                        new = True
        if ids:
            yield flush()

    return trimmed(run)


def _address(key: int | np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A number of its own for each line of each block; those of a block's first lines are least."""
    return np.asarray(key, np.int64) << np.int64(PLACE_BITS) | owner.astype(np.int64)


def _bucket(table: pa.Table) -> pa.Table:
    """One bucket: each block gets, of what several lines share, the first address that has it. Names: lines of several blocks; band keys: different
    lines, and twice the address, plus 1 if more than two lines have the key."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table
    blocks, names = table.column("block").to_pylist(), bucket % 2 == 1
    tokens, owners = ([unpack(x, t) for x in table.column(c).to_pylist()] for c, t in (("a", np.uint64), ("b", np.int32)))
    token, ends = np.concatenate(tokens), np.cumsum([0, *map(len, tokens)]).tolist()
    whose = [unpack(x, np.int64) for x in table.column("who").to_pylist()] if "who" in table.column_names else None
    address = np.concatenate([_address(k, o) for k, o in zip(whose or blocks, owners, strict=True)])
    mark = np.concatenate([unpack(x, np.uint64 if names else np.uint16) for x in table.column("c").to_pylist()])
    order = np.lexsort((mark, token)) if names else np.argsort(token, kind="stable")
    new = np.append(True, token[order][1:] != token[order][:-1])
    if names:
        new[1:] |= mark[order][1:] != mark[order][:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    shared = size > 1 if names else np.minimum.reduceat(mark[order], start) < np.maximum.reduceat(mark[order], start)
    keep, first = np.empty(len(order), bool), np.empty(len(order), np.int64)
    answer = np.minimum.reduceat(address[order], start)
    if not names:
        answer = 2 * answer + (size > 2)
    keep[order], first[order] = np.repeat(shared, size), np.repeat(answer, size)
    rows = []
    for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        own = keep[lo:hi]
        if own.any():
            rows.append((blocks[i], bucket, None, *_closed(tokens[i][own], owners[i][own], first[lo:hi][own]), *([pack(whose[i][own])] if whose else [])))
    names, kinds = ([*NAMES, "who"], [*KINDS, pa.binary()]) if whose else (NAMES, KINDS)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _closed(*columns: np.ndarray) -> tuple[bytes, ...]:
    return tuple(map(pack, columns))


#: Band keys, then names.
FORM = Form(((np.uint64, np.int32, np.uint16), (np.uint64, np.int32, np.uint64)), ((np.uint64, np.int32, np.int64),) * 2, _closed)


def _lists(owner: np.ndarray, of: np.ndarray, *values: pa.Array) -> list[pa.Array]:
    """For each of ``of`` the list of the values whose owner it is. owner, of: in order."""
    ends = np.append(0, np.cumsum(np.searchsorted(owner, of, "right") - np.searchsorted(owner, of)))
    keep = np.isin(owner, of)
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x.filter(pa.array(keep))) for x in values]


LINES = "address long, node long, ids array<long>, bodies array<long>, line_nos array<int>, centres array<long>, keys array<array<long>>, norm string"
LINE_NAMES = ["address", "node", "ids", "bodies", "line_nos", "centres", "keys", "norm"]


def _block(table: pa.Table) -> pa.Table:
    """One block: its lines that others repeat or may be alike to, with their places; a node also has its centres, its keys of each that more than
    two lines have, and its text."""
    bucket = table.column("bucket").to_pylist()
    head = next(i for i, x in enumerate(bucket) if x < 0)
    key, ids = table.column("block")[head].as_py(), table.column("ids")[head].values
    doc, line, place = unpack(table.column("b")[head].as_py(), np.int32).reshape(3, -1)
    lines = zstandard.ZstdDecompressor().decompress(table.column("c")[head].as_py()).split(b"\n")
    node = _address(key, np.arange(len(lines)))
    own = node.copy()
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]]
    for i, b in enumerate(bucket):
        if b >= 0:
            got = [unpack(table.column(c)[i].as_py(), t) for c, t in (("a", np.uint64), ("b", np.int32), ("c", np.int64))]
            if b % 2:
                node[got[1]] = got[2]
            else:
                for held, x in zip(parts, got, strict=True):
                    held.append(x)
    token, owner, centre = map(np.concatenate, parts)
    # What equal lines share they share alike, so that one of them speaks for all.
    mine = node[owner] == own[owner]
    token, owner, centre, many = token[mine], owner[mine], centre[mine] >> 1, centre[mine] & 1
    order = np.lexsort((token, centre, owner))
    token, owner, centre, many = token[order], owner[order], centre[order], many[order]
    wanted = (node != own) | (np.bincount(place, minlength=len(lines)) > 1)
    wanted[owner] = True
    # Equal lines of other blocks send their first one's address, which must come as well.
    for i, b in enumerate(bucket):
        if b >= 0 and b % 2:
            wanted[unpack(table.column("b")[i].as_py(), np.int32)] = True
    of = np.flatnonzero(wanted)
    by = np.argsort(place, kind="stable")
    docs = pa.array(doc[by])
    third = len(ids) // 3
    places = _lists(place[by], of, ids.slice(0, third).take(docs), ids.slice(third, third).take(docs), pa.array(line[by]))
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (centre[1:] != centre[:-1]))[: len(owner)])
    ends = np.append(0, np.cumsum(np.add.reduceat(many, new))) if len(new) else np.zeros(1)
    keys = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token.view(np.int64)[many > 0]))
    pairs = _lists(owner[new], of, pa.array(centre[new]), keys)
    text = np.zeros(len(lines), bool)
    text[owner] = True
    norm = pa.array([lines[i].decode("utf-8", "replace") if text[i] else None for i in of.tolist()], pa.string())
    return pa.Table.from_arrays([pa.array(own[of]), pa.array(node[of]), *places, *pairs, norm], names=LINE_NAMES)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, bits0, ...): the size and the bitmap of each line's set."""
    for batch in sliced(batches, 1, PIECE):
        n, bits = described(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(BITS // 64))], names=["id", "n", *(f"bits{k}" for k in range(BITS // 64))])


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def alike(x: list[str], y: list[str], percent: int) -> list[bool]:
    """Whether the Jaccard of each pair is percent or more. Where it is nearly that, sets of the shingles themselves decide."""
    k, sides = len(x), [np.concatenate(list(distinct(side))) for side in (x, y)]
    n, m = (np.bincount((side >> np.uint64(48)).astype(np.int64), minlength=k) for side in sides)
    both = np.sort(np.concatenate(sides))
    same = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(48)).astype(np.int64), minlength=k)
    off = 100 * same - percent * (n + m - same)
    out = (off >= 0).tolist()
    for i in np.flatnonzero(np.abs(off) <= 200).tolist():
        a, b = shingles(x[i]), shingles(y[i])
        out[i] = 100 * len(a & b) >= percent * len(a | b)
    return out


def _verify(percent: int):
    """(a, b, ok, keys) of rows (a, b, keys, x, y); keys only of pairs that aren't alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3, PIECE // 2):
            # Every line has a character, so a slice has less than 65,536 lines.
            ok = pa.array(alike(batch.column(3).to_pylist(), batch.column(4).to_pylist(), percent))
            keys = pa.array([None if good else k for good, k in zip(ok.to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ok, keys], names=["a", "b", "ok", "keys"])

    return trimmed(run)


def line_places(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, percent: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(class, ids, bodies, line_nos): the places in one block of one of the lines that are repeated or alike; class: a number that lines alike share;
    and (id, body) that several rows have.

    bodies: xxhash64 of the documents' texts. Rows of a class come from as many blocks as have it, times the lines of it that differ.
    """
    key_sum = lambda df: F.broadcast(df) if df.count() * ENTRY_BYTES <= broadcast_bytes else df
    plan = planned(docs, text_col)
    sent = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))).mapInArrow(_send(plan.first), SENT)
    shared = scratch.save(exchanged(sent, _bucket, plan, FORM, scratch, heads=True), "shared", large=True)
    scratch.drop("sent")
    lines = scratch.save(shared.groupBy("block").applyInArrow(_block, LINES), "lines", large=True)
    third = (F.size("ids") / 3).cast("int")
    rows = shared.where("bucket < 0").select(F.explode(F.arrays_zip(*[F.slice("ids", k * third + 1, third).alias(c) for k, c in enumerate(("id", "body", "later"))])).alias("r"))
    twins = rows.where("r.later = 0").groupBy("r.id", "r.body").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "body")
    twins = scratch.save(twins, "twins")
    scratch.drop("shared")

    nodes = lines.where("norm is not null")
    asked = nodes.select(F.col("node").alias("a"), F.col("norm").alias("x"), F.explode(F.arrays_zip("centres", "keys")).alias("z"))
    asked = asked.select("a", "x", F.col("z.centres").alias("b"), F.col("z.keys").alias("keys")).where("a <> b")
    centres = nodes.where(F.array_contains("centres", F.col("node"))).select(F.col("node").alias("b"), F.col("norm").alias("y"))
    tested = asked.join(centres, "b").select("a", "b", "keys", "x", "y").mapInArrow(_verify(percent), "a long, b long, ok boolean, keys array<long>")
    tested = scratch.save(tested, "tested")
    links = tested.where("ok").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = connected_components(links, scratch, "stars")

    # Keys whose lines the centres left in several components.
    lost = labelled(labelled(tested.where("not ok"), roots, "a", "a_comp"), roots, "b", "b_comp").where("a_comp <> b_comp")
    lost = scratch.save(lost.select(F.explode("keys").alias("key")).distinct(), "open")
    index = nodes.select(F.explode(F.flatten("keys")).alias("key"), F.col("node").alias("id"), F.size(F.flatten("keys")).alias("n_keys")).join(key_sum(lost), "key", "left_semi")
    index = scratch.save(index, "left")
    ids = scratch.save(index.select("id").distinct(), "ids")
    texts = nodes.select(F.col("node").alias("id"), "norm")
    bits = ", ".join(f"bits{k} long" for k in range(BITS // 64))
    sketch = scratch.save(texts.join(key_sum(ids), "id", "left_semi").mapInArrow(trimmed(_described), f"id long, n int, {bits}"), "sketch")
    index = index.withColumn("odd", -F.col("n_keys")).drop("n_keys").join(sketch, "id")

    def near(a: dict, b: dict) -> Column:
        return (F.greatest(a["n"], b["n"]) * percent <= 100 * F.least(a["n"], b["n"])) & (differing(a, b) * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent))

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (texts.select(F.col("id").alias(k), F.col("norm").alias(side)) for k, side in (("a", "x"), ("b", "y")))
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", F.lit(None).cast("array<long>").alias("keys"), "x", "y")
        return pairs.mapInArrow(_verify(percent), "a long, b long, ok boolean, keys array<long>").where("ok").select("a", "b")

    # A line that shares more keys is nearer to its group.
    known = tested.where("not ok").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    keys_of = nodes.select(F.col("node").alias("id"), F.sort_array(F.flatten("keys")).alias("keys"))
    # Of a key that only two lines have, these two have been compared.
    roots = cluster(index, keys_of, verify, scratch, near, "odd", links, roots, known, least=3, few=16)
    places = lines.select("node", "ids", "bodies", "line_nos")
    return labelled(places, roots, "node", "class").select("class", "ids", "bodies", "line_nos"), twins


def gone_lines(places: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, body, lines): of each document the numbers of the lines that go, in order. Of a class, the place of least (id, body, line number) stays."""
    spots = F.arrays_zip("ids", "bodies", "line_nos")
    places = scratch.save(places.withColumn("spots", F.transform(spots, lambda s: F.struct(s["ids"].alias("id"), s["bodies"].alias("body"), s["line_nos"].alias("line")))).select("class", "spots"), "places")
    firsts = places.groupBy("class").agg(F.min(F.array_min("spots")).alias("stays"))
    firsts = scratch.save(firsts, "firsts")
    rest = places.join(firsts, "class").select(F.explode(F.filter("spots", lambda s: ~s.eqNullSafe(F.col("stays")))).alias("s"))
    return rest.groupBy(F.col("s.id").alias("id"), F.col("s.body").alias("body")).agg(F.sort_array(F.collect_set("s.line")).alias("lines"))


def _shorten(at: int, gone: int, copy: int | None, names: list[str], counts: tuple[str, str]):
    """Takes lines out of each text (column ``at``); column ``copy``: whether all its lines stand in another copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            texts, n_lines, n_kept = [], [], []
            copies = batch.column(copy).to_pylist() if copy is not None else [False] * len(batch)
            for text, out, twin in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(gone).to_pylist(), copies, strict=True):
                lines = [] if text is None else text.split(b"\n")
                full = [bool(x.strip()) for x in lines]
                if twin:
                    out = [k for k, x in enumerate(full) if x]
                if out:
                    left = set(range(len(lines))).difference(out)
                    text = b"\n".join([x for k, x in enumerate(lines) if k in left])
                texts.append(text)
                n_lines.append(sum(full))
                n_kept.append(n_lines[-1] - len(out or ()))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_kept, pa.int64())], names=[*names, *counts])

    return trimmed(run)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, counts: tuple[str, str] = ("n_lines", "n_kept"), broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with each text reduced to the lines that stay, and two counts: lines that aren't blank, and those of them that stay.

    Of alike lines, the one of the smallest id stays, and there the first. Blank lines stay where they are; a null text stays null, and empty
    texts and tables stay empty. Rows whose id is null come first; these, and rows that repeat an id, are
    documents of their own, in the order of the hashes of their texts. Of rows that repeat both id and text one, any, keeps its lines. Text is whole however
    long; other columns and all rows stay, whatever their names. ``counts`` must be new to the table. ``docs`` is read three times (its bytes are counted first) and must give the same rows.
    """
    if {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {counts} exist already")
    scratch = Scratch(docs.sparkSession, "lines")
    places, twins = line_places(docs, scratch, id_col, text_col, percent, broadcast_bytes)
    gone = scratch.save(gone_lines(places, scratch), "gone")
    scratch.drop("lines", "places", "firsts")
    weight = gone.agg(F.sum(4 * F.size("lines") + ENTRY_BYTES).alias("w")).first()["w"] or 0
    body, mine, lines, copy = fresh(docs, "body", "id", "lines", "copy")
    gone = gone.select(F.col("id").alias(mine), F.col("body").alias(body), F.col("lines").alias(lines))
    keyed = docs.withColumn(body, F.xxhash64(F.col(text_col).cast("string"))).withColumn(mine, F.col(id_col).cast("long"))
    twins, few = twins.select(F.col("id").alias(mine), F.col("body").alias(body)), twins.count()

    def matched(rows: DataFrame, other: DataFrame, small: bool, how: str) -> DataFrame:
        other = other.withColumnsRenamed({mine: f"{mine}2", body: f"{body}2"})
        return rows.join(F.broadcast(other) if small else other, F.col(mine).eqNullSafe(F.col(f"{mine}2")) & (F.col(body) == F.col(f"{body}2")), how).drop(f"{mine}2", f"{body}2")

    def shortened(rows: DataFrame, with_copy: bool) -> DataFrame:
        rows = matched(rows, gone, weight <= broadcast_bytes, "left").select(*docs.columns, lines, *[copy] * with_copy)
        kinds = [*docs.schema.fields, T.StructField(counts[0], T.LongType()), T.StructField(counts[1], T.LongType())]
        at, width = docs.columns.index(text_col), len(docs.columns)
        kinds[at] = T.StructField(text_col, T.StringType())
        return rows.mapInArrow(_shorten(at, width, width + 1 if with_copy else None, docs.columns, counts), T.StructType(kinds))

    if not few:
        return shortened(keyed, False)
    small = few * ENTRY_BYTES <= broadcast_bytes
    again = matched(keyed, twins, small, "left_semi").withColumn(copy, F.row_number().over(Window.partitionBy(mine, body).orderBy(F.lit(1))) > 1)
    return shortened(matched(keyed, twins, small, "left_anti"), False).unionByName(shortened(again, True))
