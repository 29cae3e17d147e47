"""SimHash near-dedup by Golay-code fuzzy hashing.

The perfect Golay code [23,12] puts each 23-bit word in the ball (radius 3) of one codeword. A segment of a fingerprint
gets the indices of the codewords nearest to itself and to its neighbours at one bit, one or about six keys; two segments at two or
fewer bits have a word within one bit of both and so share a key. By the pigeonhole principle the errors of two
fingerprints leave some segments with few, and keys of those segments meet in a join whose pairs are verified.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, free_name, rows_of, squeezed, stored

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code.
GENERATOR, LENGTH, CHECK = 0b101011100011, 23, 11
SEED = 42


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and of the high bits of a word, and the error pattern (three bits at most) of each remainder."""
    of_bit = [_remainder(1 << b) for b in range(LENGTH)]

    def sums(bits: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int32)
        for r in bits:
            out = np.concatenate([out, out ^ r])
        return out

    errors = np.zeros(1 << CHECK, np.int32)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            r = 0
            for b in bits:
                r ^= of_bit[b]
            errors[r] = sum(1 << b for b in bits)
    return sums(of_bit[:12]), sums(of_bit[12:]), errors


LOW, HIGH, ERRORS = _tables()


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword in whose ball each 23-bit word lies."""
    words = words.astype(np.int32)
    return (words ^ ERRORS[LOW[words & 0xFFF] ^ HIGH[words >> 12]]) >> CHECK


def fuzzy_keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word, and which of them aren't repeated; words at two bits or fewer within `width` share one."""
    flips = np.array([0, *(1 << b for b in range(width))], np.int32)
    keys = np.sort(nearest(words.astype(np.int32)[:, None] ^ flips), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, first


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of n words joined by spaces, repeats included; fewer words: of the whole; none: none."""
    if not words:
        return np.zeros(0, np.uint64)
    line, n, hashed = b" ".join(words), min(n, len(words)), xxhash.xxh64_intdigest
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    return np.array([hashed(line[a:b], SEED) for a, b in zip(start[: len(words) - n + 1].tolist(), stop[n - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, bits): SimHash of n-word shingles as a signed long; null and empty texts: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([majority(shingle_hashes(words_of(t), n)) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return rows_of(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, bits bigint")


#: Segments of a 64-bit fingerprint: first bit and width.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _golay_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With two errors at most, one of three segments has none and another has one at most: that one's exact bits with the other's fuzzy keys."""
    for batch in batches:
        bits = batch["bits"].to_numpy()
        word = [(bits.view(np.uint64) >> np.uint64(a)).astype(np.int64) & ((1 << w) - 1) for a, w in SEGMENTS]
        fuzzy = [fuzzy_keys(x, w) for x, (_, w) in zip(word, SEGMENTS)]
        for k, (i, j) in enumerate(permutations(range(len(SEGMENTS)), 2)):
            keys, first = fuzzy[j]
            whole = (k << 34) | (word[i][:, None] << 12) | keys
            row = np.repeat(np.arange(len(bits)), first.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(bits[row]), pa.array(whole[first])], names=["bits", "key"])


def _places(by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by bucket: each one's place in its bucket, and the bucket's size."""
    new = np.append(True, np.any([c[1:] != c[:-1] for c in by], axis=0))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    return np.arange(len(new)) - np.repeat(first, size), np.repeat(size, size)


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str], by: int, most: int | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of sorted rows in pieces that end where a bucket ends, each row's place in its bucket, and which rows are of a bucket of over `most`.

    The first `by` columns name the bucket. A bucket of over `most` rows is handed on as it comes, so that no more than that is held.
    """
    held: list[np.ndarray] = []
    spilled: list | None = None

    def handed(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        place, size = _places(rows[:by])
        over = size > most if most else np.zeros(len(size), bool)
        if spilled is not None:
            over |= np.all([c == x for c, x in zip(rows[:by], spilled)], axis=0)
        return rows, place, over

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch[c].to_numpy() for c in names]
        held = [np.concatenate(c) for c in zip(held, rows)] if held else rows
        other = np.flatnonzero(np.any([c != c[-1] for c in held[:by]], axis=0))
        if len(other):
            yield handed([c[: other[-1] + 1] for c in held])
            held = [c[other[-1] + 1 :] for c in held]
        if most and (len(held[0]) > most or spilled is not None and all(c[0] == x for c, x in zip(held[:by], spilled))):
            spilled = [c[0] for c in held[:by]]
            yield handed(held)
            held = []
    if held:
        yield handed(held)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits two arrays of signed longs differ in."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def joining(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links i, j are enough to join all that the links join; root, the least number that each reaches, is brought up to date."""
    taken, open_ = [np.zeros(0, np.int64)], np.arange(len(i))
    while True:
        ri, rj = root[i[open_]], root[j[open_]]
        apart = ri != rj
        open_, ri, rj = open_[apart], ri[apart], rj[apart]
        if not len(open_):
            return np.concatenate(taken)
        # each root takes one link to a smaller one
        high, first = np.unique(np.maximum(ri, rj), return_index=True)
        root[high] = np.minimum(ri, rj)[first]
        taken.append(open_[first])
        while (root[root] != root).any():
            root[:] = root[root]


#: Fingerprints of a Golay key that are compared with each other in memory; the members of a fuller one meet by the words next to them.
CROWDED = 512


def _close(crowded: int):
    """Rows sorted by key and bits: pairs within two bits that join all such pairs of a bucket; members of a crowded one without a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bits), place, over in _buckets(batches, ["key", "bits"], 1, crowded):
            late = np.unique(bits[over])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(late), pa.int64()), pa.array(late)], names=["a", "b"])
            own, back, i = np.flatnonzero((place > 0) & ~over), 1, [np.zeros((2, 0), np.int64)]
            while len(own):
                ok = own[differing(bits[own], bits[own - back]) <= 2]
                i.append(np.stack([ok, ok - back]))
                back += 1
                own = own[place[own] >= back]
            i, j = np.concatenate(i, 1)
            some = joining(np.arange(len(bits)), i, j)
            pair = np.unique(np.stack([bits[j[some]], bits[i[some]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pair.T.copy()], names=["a", "b"])

    return run


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) among distinct fingerprints that join all pairs at two bits or fewer: prints has column bits.

    Fingerprints meet by their Golay keys; those of a key are compared, and of the pairs at two bits or fewer as many are kept as
    join them all, fewer than members. The members of a key with over `crowded` of them name the 65 words within one bit
    of each instead. Those that name the same word are at two bits or fewer, 65 at most, and any two at two bits or fewer name
    a word in common: no pair is lost, and no key is held whole in memory.
    """
    parts = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = prints.select("bits").mapInArrow(_golay_keys, "bits bigint, key bigint")
    met = stored(keys.repartition(parts, "key").sortWithinPartitions("key", "bits").mapInArrow(_close(crowded), "a bigint, b bigint"), "met")
    found, late = met.where("a IS NOT NULL").distinct(), met.where("a IS NULL").select(F.col("b").alias("bits")).distinct()
    if late.isEmpty():
        return found
    named = stored(late.select("bits", F.explode(F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])).alias("z")), "balls")
    least = named.groupBy("z").agg(F.min("bits").alias("lo"), F.max("bits").alias("hi")).where("lo <> hi").select("z", F.col("lo").alias("a"))
    return found.unionByName(named.join(least, "z").where("a <> bits").select("a", F.col("bits").alias("b"))).distinct()


def components(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, bits, component_id): documents linked at two or fewer differing bits, named by their smallest doc_id.

    Null and empty texts have fingerprint zero and are linked by it. Documents with equal fingerprints are one node of the graph, so a
    large group of copies costs one row. Rows that share a doc_id get a row each. An empty table gives none; other columns are ignored.
    """
    prints = stored(fingerprints(docs, n), "prints")
    nodes = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "nodes")
    roots = stored(connected_components(links(nodes)), "roots")
    named = nodes.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "root").select("bits", "component_id"), "bits").select("doc_id", "bits", "component_id")


#: The stage's fingerprint: four 23-bit segments of a SimHash over distinct words.
WIDE = 4


class Digests(dict):
    """128-bit digests of words, kept while there are fewer than 100,000."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 100_000:
            self.clear()
        self[word] = d = xxhash.xxh3_128_digest(word)
        return d


MASK = (1 << LENGTH) - 1
#: Bits of a sketch that go in one long with a key of 27 bits; the other 64 go in a second.
FEW = 36
#: Fixed odd numbers that put shingle hashes in 100 orders.
ORDERS = np.random.default_rng(29).integers(1, 1 << 63, FEW + 64, dtype=np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray) -> tuple[int, int]:
    """One bit of the least hash in each of 100 orders, as 36 and 64 bits: sets of likeness j differ in (1 - j) / 2 of them."""
    low = np.full(len(ORDERS), (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 4096):
            low = np.minimum(low, (hashes[k : k + 4096, None] * ORDERS).min(0))
    bits = (low >> np.uint64(20)) & np.uint64(1)
    few, rest = (np.packbits(np.resize(np.append(b, np.zeros(28, np.uint64)), 64).astype(bool), bitorder="little").view("<u8")[0] for b in (bits[:FEW], bits[FEW:]))
    return int(few), int(rest)


def _wide(n: int):
    """Text key (128-bit digest of the words), four 23-bit segments in two longs, the sketch of the n-word shingles in two more, and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, mask = Digests(), (1 << 2 * LENGTH) - 1
        for whole in batches:
            for k in range(0, whole.num_rows, 500):  # a few texts at a time
                batch = whole.slice(k, 500)
                out: list[list] = [[] for _ in NODE]
                for text in batch["text"].to_pylist():
                    words = words_of(text)
                    hashes = np.frombuffer(b"".join(map(cache.__getitem__, set(words))), np.uint64).reshape(-1, 2)
                    digest = xxhash.xxh3_128_intdigest(b" ".join(words))
                    for column, x in zip(out, (digest >> 64, digest & (1 << 64) - 1, majority(hashes[:, 0]) & mask, majority(hashes[:, 1]) & mask, *sketch(shingle_hashes(words, n)), len(words))):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in out)], names=[*batch.schema.names[:-1], *NODE])

    return run


#: Of a text: digest, fingerprint, sketch, words.
NODE = ["t1", "t2", "lo", "hi", "z1", "z2", "words"]


def _wide_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two of the four segments, both one's fuzzy keys with both the other's: they meet if two segments have two errors at most.

    x: 27 bits of the key and 36 of the sketch; y: the rest of it.
    """
    for batch in batches:
        lo, hi, z1, z2 = (batch[c].to_numpy() for c in ("lo", "hi", "z1", "z2"))
        fuzzy = [fuzzy_keys(x & MASK, LENGTH) for x in (lo, lo >> LENGTH, hi, hi >> LENGTH)]
        for k, (i, j) in enumerate(combinations(range(WIDE), 2)):
            (a, fa), (b, fb) = fuzzy[i], fuzzy[j]
            ra, ca = np.nonzero(fa)
            n = fb.sum(1)
            begin = np.cumsum(n) - n
            flat = b[fb]
            size = n[ra]
            row = np.repeat(ra, size)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            key = (k << 24) | (np.repeat(a[ra, ca], size).astype(np.int64) << 12) | flat[begin[row] + nth]
            yield pa.RecordBatch.from_arrays([pa.array(key << FEW | z1[row]), pa.array(z2[row])], names=["x", "y"])


KEYED = "x bigint, y bigint"
#: Parts in which the rows of a hot key are dealt out; members of a block, and words of texts compared at once.
DEAL, BLOCK, WORDS = 64, 4096, 500_000
MET = "kind int, key bigint, z1 bigint, z2 bigint, y1 bigint, y2 bigint"


def _met(bits: int, hot: np.ndarray):
    """Rows sorted by key: as many pairs of a key with sketches within `bits` bits as join all that such pairs join.

    The first member of a key leads; those near it follow it, the first of the rest leads those near it, and so on. Members of
    different leaders are then compared, the larger following with the others, so that a large group of copies takes one step.
    Kind 0: a pair. Of hot keys, which come in parts, also kind 1: a member, and kind 2: a leader.
    """

    def rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        cells = [pa.array(c) for c in columns] + [pa.nulls(n, pa.int64())] * (5 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *cells], names=[c.split()[0] for c in MET.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = (pa.RecordBatch.from_arrays([pa.array(b["x"].to_numpy() >> FEW), *b.columns], names=["key", "x", "y"]) for b in batches)
        for (key, x, z2), place, _ in _buckets(keyed, ["key", "x", "y"], 1):
            z1, here = x & ((1 << FEW) - 1), np.arange(len(x))
            first = here - place
            size = np.bincount(first, minlength=len(x))[first]
            parted, root, pairs = np.isin(key, hot), here.copy(), []

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return differing(z1[a], z1[b]) + differing(z2[a], z2[b]) <= bits

            left = np.flatnonzero((size > 1) | parted)
            while len(left):
                new = np.append(True, first[left[1:]] != first[left[:-1]])
                lead = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
                follows = (left != lead) & near(left, lead)
                root[left[follows]] = lead[follows]
                pairs.append(np.stack([left[follows], lead[follows]]))
                led = left[(left == lead) & parted[left]]
                if len(led):
                    yield rows(2, key[led], z1[led], z2[led])
                left = left[(left != lead) & ~follows]
            # in keys with followers of several leaders
            following = np.bincount(root, minlength=len(x))
            several = (np.bincount(first, following[here] > 1, len(x)) > 0) & (np.bincount(first, root == here, len(x)) > 1)
            asked = np.flatnonzero(several[first])
            asked = asked[np.lexsort((root[asked], -following[root[asked]], first[asked]))]
            ranks, _ = _places([first[asked]])
            within, _ = _places([first[asked], root[asked]])
            at = np.flatnonzero(ranks > within)
            joined, back = root.copy(), 1
            while len(at):
                now = at[within[at] < back]
                a, b = asked[now], asked[now - back]
                ok = near(a, b)
                a, b = a[ok], b[ok]
                some = joining(joined, a, b)
                pairs.append(np.stack([a[some], b[some]]))
                back += 1
                at = at[ranks[at] >= back]
            a, b = np.concatenate([np.zeros((2, 0), np.int64), *pairs], 1)
            pair = np.unique(np.stack([c[k] for k in (a, b) for c in (z1, z2)], 1), axis=0)
            yield rows(0, np.zeros(len(pair), np.int64), *pair.T.copy())
            yield rows(1, key[parted], z1[parted], z2[parted])

    return run


def _other_pairs(bits: int):
    """Rows sorted by key, i, j: members (of blocks i and j) whose sketches are within `bits` bits and whose roots differ, as many as join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j, block, z1, z2, node, root), place, _ in _buckets(batches, ["key", "i", "j", "block", "z1", "z2", "node", "root"], 3):
            _, group = np.unique(root, return_inverse=True)
            own, back, pairs = np.flatnonzero(place > 0), 1, []
            joined = np.arange(len(node))
            while len(own):
                other = own - back
                ok = (group[own] != group[other]) & (differing(z1[own], z1[other]) + differing(z2[own], z2[other]) <= bits) & ((i[own] == j[own]) | (block[own] != block[other]))
                some = joining(joined, own[ok], other[ok])
                pairs.append(np.stack([node[own[ok][some]], node[other[ok][some]]]))
                back += 1
                own = own[place[own] >= back]
            a, b = np.concatenate([np.zeros((2, 0), np.int64), *pairs], 1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


class Shingles:
    """Shingle sets of compressed texts."""

    def __init__(self, n: int):
        import zstandard

        self.n, self.unpack = n, zstandard.ZstdDecompressor()

    def of(self, raw: bytes) -> np.ndarray:
        return np.unique(shingle_hashes(words_of(self.unpack.decompress(raw).decode("utf-8", "surrogatepass")), self.n))


def alike(sets: list[np.ndarray], asks: np.ndarray, least: float) -> np.ndarray:
    """Pairs (2, k) of sets with a likeness of `least` or more, as many as join all such pairs one of which asks.

    Each shingle lists the sets that hold it; a set's own lists, counted, tell what it shares with every other.
    """
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, ids = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(ids, kind="stable")
    lists, end = owner[by], np.cumsum(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    begin, root, pairs = np.append(0, end), np.arange(len(sets)), [np.zeros((2, 0), np.int64)]
    stop = np.cumsum(size)
    for k in np.flatnonzero(asks):
        mine = ids[stop[k] - size[k] : stop[k]]
        mine = mine[begin[mine + 1] - begin[mine] > 1]
        if not len(mine):
            continue
        both = np.bincount(np.concatenate([lists[begin[x] : begin[x + 1]] for x in mine.tolist()]), minlength=len(sets))
        like = np.flatnonzero((both > 0) & (both >= least * (size + size[k] - both)))
        like = like[like != k]
        some = joining(root, np.full(len(like), k), like)
        pairs.append(np.stack([np.full(len(some), k), like[some]]))
    return np.concatenate(pairs, 1)


def _compared(least: float, n: int):
    """Rows sorted by cluster, i, j: its texts are compared with each other, those that don't ask only with those that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, at = Shingles(n), [], None

        def out() -> pa.RecordBatch:
            node = np.array([x[0] for x in held], np.int64)
            a, b = alike([x[2] for x in held], np.array([x[1] for x in held], bool), least)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for batch in batches:
            for *key, asks, node, raw in zip(*(batch[c].to_pylist() for c in ("cluster", "i", "j", "asks", "node", "raw"))):
                if held and key != at:
                    yield out()
                    held = []
                at = key
                held.append((node, asks, shingles.of(raw)))
        if held:
            yield out()

    return run


def _jaccard(least: float, n: int):
    """Of pairs with both texts, those whose shingle sets are alike; a text that comes again is taken apart once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = functools.lru_cache(64)(Shingles(n).of)
        for batch in batches:
            keep = [len(alike([a, b], np.array([True, False]), least)[0]) > 0 for a, b in zip(map(of, batch["ta"].to_pylist()), map(of, batch["tb"].to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, similarity: float = 0.8, n: int = 5, bits: int = 22) -> DataFrame:
    """(doc_id, t1, t2, class_id): documents joined by verified likeness of n-word shingle sets, or by equal words.

    Distinct word sequences are the nodes. Their wide SimHashes meet by Golay keys of two segments, and texts of a key whose sketches are
    within `bits` of 100 bits are of one cluster (at a likeness of 0.8 all but 1 in 10,000 pairs are, of unlike texts 2 in 100 million). In a
    cluster all whole texts are compared, each sent to one task once, or by blocks where a cluster is large: so no link that a key holds is
    left out, and no pair of texts is a row. What the keys themselves hold is measured in README. class_id is the smallest doc_id of the class.
    Null and empty texts have no words and form one class. Rows with equal words are one node, whatever their doc_ids. An empty table gives no rows.
    Rows without a doc_id name no class and are better left out. Other columns are ignored.
    """
    rows = rows_of(docs, doc_id="bigint", text="string")
    prints = stored(rows.mapInArrow(_wide(n), ", ".join(f"{c} bigint" for c in ["doc_id", *NODE])), "wide")
    nodes = stored(prints.groupBy("t1", "t2").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in NODE[2:]]), "nodes")
    full = nodes.where("words > 0")
    near = _clusters(full, bits)
    size = near.groupBy("cluster").agg(F.sum("words").alias("all"))
    # joins that carry texts are shuffled at every size, as they must be at a large one
    texts = stored(squeezed(rows).join(near.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("raw").alias("raw")), "texts").withColumnRenamed("doc_id", "node")
    small, large = near.join(size.where(F.col("all") <= WORDS), "cluster"), stored(near.join(size.where(F.col("all") > WORDS), "cluster"), "large")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = small.select("cluster", F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(True).alias("asks"), "node")
    links = None
    if not large.isEmpty():
        # each text of a large cluster is compared with the cluster's first one; then all others with the largest class and with each other
        star = large.groupBy("cluster").agg(F.min("node").alias("a")).join(large, "cluster").where("a <> node").select("a", F.col("node").alias("b"))
        links = _verified(texts, star, similarity, n)
        dealt = dealt.unionByName(_blocks(_named(large, stored(connected_components(links), "roots"))))
    sent = dealt.join(texts.hint("merge"), "node").repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    found = stored(sent.select("cluster", "i", "j", "asks", "node", "raw").mapInArrow(_compared(similarity, n), "a bigint, b bigint"), "alike")
    roots = stored(connected_components(found if links is None else found.unionByName(links)), "roots")
    named = _named(nodes.select("t1", "t2", "node"), roots).select("t1", "t2", F.col("root").alias("class_id"))
    return prints.select("doc_id", "t1", "t2").join(named, ["t1", "t2"])


def _clusters(full: DataFrame, bits: int) -> DataFrame:
    """(node, words, cluster) of the texts that share a key with one of a near sketch: what such pairs join is a cluster."""
    parts = max(1, int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    prints = full.select("lo", "hi", "z1", "z2").distinct()
    hot, key, name = _hot(prints, parts), F.shiftright("x", FEW), ["z1", "z2"]
    salt = F.when(key.isin(hot.tolist()), F.pmod(F.xxhash64("x", "y"), F.lit(DEAL))).otherwise(0)
    keys = prints.mapInArrow(_wide_keys, KEYED)
    met = stored(keys.repartition(parts, key, salt).sortWithinPartitions("x").mapInArrow(_met(bits, hot), MET), "met")
    pairs = met.where("kind = 0")
    if len(hot):
        # the leaders of a hot key's parts meet by themselves
        again = met.where("kind = 2").select(F.shiftleft("key", FEW).bitwiseOR(F.col("z1")).alias("x"), F.col("z2").alias("y"))
        pairs = pairs.unionByName(again.repartition(parts, key).sortWithinPartitions("x").mapInArrow(_met(bits, np.zeros(0, np.int64)), MET).where("kind = 0"))
    # texts of one sketch are of one cluster, and the smallest stands for them
    heads = full.groupBy(*name).agg(F.min("node").alias("head"))
    other = heads.select(F.col("z1").alias("y1"), F.col("z2").alias("y2"), F.col("head").alias("b"))
    ends = pairs.select(*name, "y1", "y2").distinct().join(heads.withColumnRenamed("head", "a"), name).join(other, ["y1", "y2"]).select("a", "b")
    within = full.join(heads, name).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    edges = stored(ends.unionByName(within).distinct(), "near")
    roots = stored(connected_components(edges), "roots")
    if len(hot):
        waits = stored(_named(met.where("kind = 1").join(heads.withColumnRenamed("head", "node"), name).select("key", "z1", "z2", "node"), roots), "waits")
        more = _paired(waits, bits, parts)
        if not more.isEmpty():
            roots = stored(connected_components(edges.unionByName(more)), "roots")
    return stored(full.select("node", "words").join(roots, "node").withColumnRenamed("root", "cluster"), "clusters")


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of their node; a node without links is its own."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _hot(prints: DataFrame, parts: int) -> np.ndarray:
    """Keys that hold many texts, 4 * parts at most, by one text in DEAL: they only tell which rows are dealt out in several parts."""
    some = prints.where(F.pmod(F.xxhash64("lo", "hi", "z1", "z2"), F.lit(DEAL)) == 0).mapInArrow(_wide_keys, KEYED)
    counts = some.groupBy(F.shiftright("x", FEW).alias("key")).count().where("count >= 64").orderBy(F.desc("count"), "key").limit(4 * parts)
    return np.sort(np.array([r.key for r in counts.collect()], np.int64))


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float, n: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are alike; pairs of one a come one after the other."""
    read = pairs.join(texts.select(F.col("node").alias("b"), F.col("raw").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("raw").alias("ta")), "a").select("a", "b", "ta", "tb")
    return stored(read.mapInArrow(_jaccard(similarity, n), "a bigint, b bigint"), "alike")


def _blocks(large: DataFrame) -> DataFrame:
    """(cluster, i, j, asks, node) of large clusters with several classes: blocks of the texts outside the largest class ask all blocks."""
    classes = large.groupBy("cluster", "root").agg(F.sum("words").alias("n"))
    top = classes.groupBy("cluster").agg(F.max_by("root", F.struct("n", F.negative("root"))).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    rows = large.join(top, "cluster").withColumn("asks", F.col("root") != F.col("top"))
    of = rows.groupBy("cluster").agg(*[F.ceil(2 * F.sum(F.when(w, F.col("words")).otherwise(0)) / WORDS).alias(c) for c, w in (("some", F.col("asks")), ("rest", ~F.col("asks")))])
    rows = rows.join(of, "cluster").withColumn("block", F.when(F.col("asks"), F.pmod(F.xxhash64("node"), F.col("some"))).otherwise(F.col("some") + F.pmod(F.xxhash64("node"), F.col("rest"))))
    to = F.when(F.col("asks"), F.sequence(F.lit(0).cast("bigint"), F.col("some") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("some") - 1))
    rows = rows.withColumn("to", F.explode(to))
    return rows.select("cluster", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "asks", "node")


def _paired(waits: DataFrame, bits: int, parts: int) -> DataFrame:
    """(a, b): near members of a hot key whose clusters differ: waits has key, z1, z2, node, root.

    Keys of one cluster have none. Large ones are dealt out in blocks, each two of which meet.
    """
    apart = waits.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("x <> y").select("key", "blocks")
    dealt = waits.join(apart, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "block", "z1", "z2", "node", "root")
    return stored(dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_other_pairs(bits), "a bigint, b bigint").distinct(), "close")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents whose doc_id names their class, all columns as they are; of rows with equal doc_id and text one stays.

    Rows without a doc_id can't be named and stay as they are.
    """
    near = stored(near_duplicates(docs.where(F.col("doc_id").isNotNull()), **options), "classes")
    name = free_name(docs, "_kept")
    kept = near.where("doc_id = class_id").select(F.col("doc_id").alias(name)).distinct()
    stay = docs.join(kept.hint("merge"), F.col("doc_id").cast(T.LongType()) == F.col(name), "left_semi")
    if not near.groupBy("doc_id", "t1", "t2").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.where(F.col("doc_id").isNull()))
