"""Near-duplicate detection by HyperMinHash.

A document's set is its distinct word shingles.  Shingle hashes are dealt to
buckets; a bucket's register holds the leading-zero count (6 bits) and the
next 10 bits of its least hash.  Two sets of registers are kept:

* 512 buckets for candidates.  Empty ones take the register of the first
  full bucket in an order of their own; 73 bands of 7 registers make the
  candidate keys (a pair of similarity 0.8 shares none with probability
  4e-8), and 4 bits of each register a short sketch that ranks hubs.
* 2,048 buckets for the estimate, only the full ones, made of the texts of the
  classes that the listing reads.  Registers that agree,
  less the agreement of different hashes that chance brings (the collision
  term), over buckets that either set fills estimate the similarity; its
  error follows from the share of the union's shingles that the buckets
  show (sets of a few hundred shingles show nearly all of theirs).

Rows with equal sets are one class, and only its representative goes on, so
copies never meet.  In hub rounds each class is compared with one member
(the hub) of each of its band groups by the short sketch, and with the
likeliest of these on full sets; what verifies is joined into components.
Further rounds look only at band groups that hold several components, with
other hubs each time, while they settle at least half of them.  What then
remains is listed: within each band group the members of different components, once per
pair (in the first band that they share), if the estimate from the
whole registers isn't over 4.5 standard errors below the threshold.  No other
filter and no cap leaves a pair out, and pairs that are connected already
are never listed.  All candidates are verified on full sets.

Defined cases: a null or empty text has an empty set and is linked with
nothing; a text shorter than a shingle is one shingle, all its words; rows
are compared by their own texts whatever their ids, so rows without an id,
or that share one, keep results of their own; a component's id is its least
id (null if none of its rows has one); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcspark.llm.common import fresh, join_groups, parts, ship_package, staged
from lcspark.llm.components import components
from lcspark.llm.textvec import mix, segment_hash, slices

SHINGLE = 5
PERCENT = 80
BUCKET_BITS = 9
MANTISSA_BITS = 10
ROWS, BANDS = 7, 73
REGISTERS = ROWS * BANDS
# Buckets of the estimate.
WHOLE_BITS = 11
# Hub rounds go on while a round leaves no more than this share of the band
# members open; they only save work, as the listing after them is complete.
SETTLED = 0.5
# The hubs that a class is verified with in a round.
HUBS_VERIFIED = 3
# Disagreeing 4-bit registers up to which a hub is likely, and a pair's
# estimate from the whole registers is looked at.  At similarity 0.8, 96 of
# 511 disagree; the error of the short sketch (buckets that hold several
# shingles, filled buckets, chance agreement) is 10 at most.
MOST_DISAGREE = 140
# Standard errors below the threshold up to which a pair is verified.
MOST_ERRORS = 4.5
# Members of a block of a large band group, of a bin of small ones, and the
# pairs that are compared at a time.
BLOCK_MEMBERS, BIN_MEMBERS, STRIP_PAIRS = 512, 8192, 1 << 13
_PROBES = 64
_NULL_ID = -(2 ** 63)


# -- sets and registers, inside tasks ------------------------------------
def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        # bytes.lower() changes A-Z only; its white space is that of the word rule
        coded = [t.encode("utf-8", "surrogatepass").lower() for t in texts[a:b]]
        joined = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)
        solid = ~((joined == 32) | ((joined >= 9) & (joined <= 13)))
        at = np.flatnonzero(solid)
        starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        word = segment_hash(joined[at], starts)
        text_at = np.cumsum([1, *[len(c) + 1 for c in coded]])[:-1]
        cuts = np.searchsorted(at[starts], np.append(text_at, len(joined)))
        rolled = word.copy()
        for step in range(1, shingle):
            rolled[:-step] = rolled[:-step] * np.uint64(0x9FB21C651E98DF25) + word[step:]
        rolled = mix(rolled)
        for first, last in zip(cuts[:-1], cuts[1:]):
            n = last - first
            if n >= shingle:
                out.append(np.unique(rolled[first:last - shingle + 1]))
            elif n:
                whole = hashlib.blake2b(word[first:last].tobytes(), digest_size=8).digest()
                out.append(np.frombuffer(whole, np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _probe_table() -> np.ndarray:
    """probe[i, bucket]: the i-th bucket that an empty one looks at."""
    n = 1 << BUCKET_BITS
    at = np.arange(_PROBES, dtype=np.uint64)[:, None] * np.uint64(n) + np.arange(n, dtype=np.uint64)
    return (mix(at + np.uint64(0x51ED2701)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _register(h: np.ndarray, bucket_bits: int) -> np.ndarray:
    """Leading zeros and mantissa of hashes without their bucket's bits."""
    rest = (h & np.uint64((1 << (64 - bucket_bits)) - 1)).astype(np.float64)
    fraction, length = np.frexp(rest)
    zeros = (64 - bucket_bits) - length
    mantissa = np.maximum((fraction * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64) & ((1 << MANTISSA_BITS) - 1)
    return (np.minimum(zeros, 63) << MANTISSA_BITS) | mantissa


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """[texts, buckets] uint16; rows of empty sets are all ones."""
    n, buckets = len(sets), 1 << BUCKET_BITS
    out = np.full((n, buckets), -1, np.int32)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    h = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    cell = doc * buckets + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))     # hashes are sorted: the first of a bucket is its least
    out.ravel()[cell[first]] = _register(h[first], BUCKET_BITS)
    full = out >= 0
    probes = _probe_table()
    row, bucket = np.nonzero(~full & full.any(axis=1)[:, None])
    for i in range(_PROBES):
        if not len(row):
            break
        source = probes[i, bucket]
        hit = full[row, source]
        out[row[hit], bucket[hit]] = out[row[hit], source[hit]]
        row, bucket = row[~hit], bucket[~hit]
    for r in np.unique(row):                              # few full buckets: the least in an order per empty bucket
        mine, sources = bucket[row == r], np.flatnonzero(full[r])
        order = mix(mine.astype(np.uint64)[:, None] * np.uint64(buckets) + sources.astype(np.uint64) + np.uint64(0xABCD01))
        out[r, mine] = out[r, sources[order.argmin(axis=1)]]
    return out.astype(np.uint16)


def whole_registers(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Of each set: its full buckets with their whole registers, as int32
    (bucket above 16 bits of register), ascending."""
    n, buckets = len(sets), 1 << WHOLE_BITS
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    h = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    cell = doc * buckets + (h >> np.uint64(64 - WHOLE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    values = ((cell[first] % buckets) << 16 | _register(h[first], WHOLE_BITS)).astype(np.int32)
    return np.split(values, np.searchsorted(cell[first], np.arange(1, n) * buckets)) if n else []


def chance_agreement() -> float:
    """Probability that the registers of two unrelated least hashes agree:
    the sum of the squared probabilities of all registers, for hashes that
    are the least of many (exponentially distributed)."""
    octave = 2.0 ** np.arange(-40, 8)[:, None]
    edges = octave * (1 + np.arange((1 << MANTISSA_BITS) + 1) / (1 << MANTISSA_BITS))
    return float((np.diff(-np.exp(-edges), axis=1) ** 2).sum())


CHANCE = chance_agreement()


# Lowest bits of a band's key: the band's number.
BAND_BITS = 7


def band_keys(regs: np.ndarray) -> np.ndarray:
    """[texts, BANDS] int64: a hash of the band's registers above its number."""
    cut = regs[:, :REGISTERS].reshape(-1, ROWS).astype(np.uint64)
    band = np.tile(np.arange(BANDS, dtype=np.uint64), len(regs))
    key = mix(band + np.uint64(1))
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, j])
    key = key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | band
    return key.reshape(len(regs), BANDS).view(np.int64)


SKETCH_LONGS = (BANDS + 1) // 2
# Lowest bit of each register's four, in the two 32-bit halves of a long.
_LOW_BITS = 0x0111111101111111


def sketches(regs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """[texts, SKETCH_LONGS] int64.  A band is 32 bits: four of each of its
    registers and, on top, four of its key."""
    cut = mix(regs[:, :REGISTERS].astype(np.uint64)).reshape(len(regs), BANDS, ROWS) & np.uint64(15)
    field = (keys.view(np.uint64) >> np.uint64(60)) << np.uint64(28)
    for j in range(ROWS):
        field |= cut[:, :, j] << np.uint64(4 * j)
    field = np.pad(field, ((0, 0), (0, 2 * SKETCH_LONGS - BANDS)))
    return (field[:, 0::2] | field[:, 1::2] << np.uint64(32)).view(np.int64)


def signatures(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key (16 bytes, of the text), n_shingles, set_key (16 bytes,
    equal for equal sets), bands, sketch (null for an empty set)."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sets = shingle_sets([t or "" for t in part.column("text").to_pylist()], shingle)
            regs = registers(sets)
            keys = band_keys(regs)
            empty = pa.array(np.array([not len(s) for s in sets], bool))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
                     for x in (keys, sketches(regs, keys))]
            lists = [pa.compute.if_else(empty, pa.scalar(None, x.type), x) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), *lists],
                ["id", "text_key", "n_shingles", "set_key", "bands", "sketch"])
    return rows.mapInArrow(run, "id bigint, text_key binary, n_shingles bigint, set_key binary, bands array<bigint>, sketch array<bigint>")


def whole_of(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, whole (the whole registers) of rows of node and text.  They are
    longer than all else of a signature and few classes need them, so they
    are made of the texts when those are known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sets = shingle_sets([t or "" for t in part.column("text").to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(whole_registers(sets), pa.list_(pa.int32()))], ["node", "whole"])
    return texts.select("node", "text").mapInArrow(run, "node bigint, whole array<int>")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


# -- candidates ------------------------------------------------------------
def _differing_registers(x: Column) -> Column:
    """Number of 4-bit registers that are not 0 in a long."""
    any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.bit_count(any_bit.bitwiseAND(F.lit(_LOW_BITS)))


def disagreeing(a: str = "a_sketch", b: str = "b_sketch") -> Column:
    """Number of 4-bit registers in which two short sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + _differing_registers(x))


def _sizes_allow(percent: int) -> Column:
    return F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")


def band_members(reps: DataFrame) -> DataFrame:
    """key, band, node and root (the node) of the classes that share a band
    with another.  The bands are dealt out once: groups and members are read
    from the same shuffle, which needs the same columns for both."""
    banded = reps.select("node", F.explode("bands").alias("key")).repartition("key")
    shared = banded.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("key")
    band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
    return banded.join(shared.hint("merge"), "key").select("key", band.alias("band"), "node", F.col("node").alias("root"))


def _side(reps: DataFrame, name: str) -> DataFrame:
    return reps.select(F.col("node").alias(name), F.col("n_shingles").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the band groups that hold several components, with the
    root of theirs and the group's size."""
    rooted = (members.select("key", "band", "node").join(labels, "node", "left")
              .select("key", "band", "node", F.coalesce("root", "node").alias("root")))
    several = (rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size"))
               .where("x < y").select("key", "size"))
    return staged(rooted.join(several, "key"), "mixed-members")


def _hub_candidates(members: DataFrame, reps: DataFrame, percent: int, order: int) -> DataFrame:
    """(a, b): classes with the likeliest of their band groups' hubs in
    another component."""
    first = F.struct(F.xxhash64("node", F.lit(order)).alias("o"), "node", "root")
    hubs = members.groupBy("key").agg(F.min(first).alias("hub")).select("key", "hub.node", "hub.root").toDF("key", "a", "a_root")
    pairs = members.join(hubs, "key").where("root <> a_root").select("a", F.col("node").alias("b")).distinct()
    likely = (pairs.join(_side(reps, "a"), "a").join(_side(reps, "b"), "b").where(_sizes_allow(percent))
              .select("a", "b", disagreeing().alias("d")).where(F.col("d") <= MOST_DISAGREE))
    best = likely.groupBy("b").agg(F.sort_array(F.collect_set(F.struct("d", "a"))).alias("hubs"))
    return (best.select("b", F.explode(F.slice("hubs", 1, HUBS_VERIFIED)).alias("hub"))
            .select(F.least("hub.a", "b").alias("a"), F.greatest("hub.a", "b").alias("b")).distinct())


def similarity(whole_a: np.ndarray, whole_b: np.ndarray) -> tuple[float, int]:
    """From two sets' whole registers: how many agree, corrected for
    collisions (of the buckets that both fill with different hashes, the
    share ``CHANCE`` agrees all the same), and the buckets that either fills.
    The quotient estimates the similarity."""
    same = len(np.intersect1d(whole_a, whole_b, assume_unique=True))
    both = len(np.intersect1d(whole_a >> 16, whole_b >> 16, assume_unique=True))
    return max(0.0, (same - CHANCE * both) / (1 - CHANCE)), len(whole_a) + len(whole_b) - both


def may_be_similar(agree: float, either: int, n_a: int, n_b: int, percent: int) -> bool:
    """The estimate isn't ``MOST_ERRORS`` standard errors and one register
    below the threshold t.  At similarity t the union has (n_a + n_b) / (1 + t)
    shingles; the buckets show ``either`` of them, drawn without replacement."""
    t = percent / 100
    unseen = max(0.0, 1 - either * (1 + t) / (n_a + n_b))
    return agree + MOST_ERRORS * (t * (1 - t) * either * unseen) ** 0.5 + 1 >= t * either


class _Members:
    """Band members of an Arrow table as arrays."""

    def __init__(self, table: pa.Table):
        def column(name):
            return table.column(name).combine_chunks()

        def ragged(name):
            c = column(name)
            cuts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(c).to_numpy())])
            return cuts, c.flatten().to_numpy()
        self.key, self.node, self.root, self.n, self.mine = (
            column(c).to_numpy() for c in ("key", "node", "root", "n_shingles", "mine"))
        self.sketch = column("sketch").flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
        (self.cuts, self.values), (self.earlier_cuts, self.earlier) = ragged("whole"), ragged("earlier")

    def whole(self, i: int) -> np.ndarray:
        return self.values[self.cuts[i]:self.cuts[i + 1]]

    def pairs(self, left: np.ndarray, right: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
        """Candidates between two blocks of a band group, or within one (no
        ``right``): other components, sizes and short sketches that allow the
        threshold, no earlier band in common, and the estimate."""
        others = left if right is None else right
        strip = max(1, STRIP_PAIRS // len(others))
        for at in range(0, len(left), strip):
            some = left[at:at + strip]
            ok = self.root[some][:, None] != self.root[others]
            if right is None:
                ok &= np.arange(at, at + len(some))[:, None] < np.arange(len(left))
            n, m = self.n[some][:, None], self.n[others]
            ok &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            x, y = np.nonzero(ok)
            x, y = some[x], others[y]
            differ = self.sketch[x] ^ self.sketch[y]
            differ |= differ >> np.uint64(1)
            differ |= differ >> np.uint64(2)                         # a register's lowest bit: any of its four
            near = np.bitwise_count(differ & np.uint64(_LOW_BITS)).sum(axis=1) <= MOST_DISAGREE
            x, y = x[near], y[near]
            bands = self.earlier_cuts[left[0] + 1] - self.earlier_cuts[left[0]]     # equal within a band group
            if bands and len(x):
                place = np.arange(bands)
                first = (self.earlier[self.earlier_cuts[x][:, None] + place] != self.earlier[self.earlier_cuts[y][:, None] + place]).all(axis=1)
                x, y = x[first], y[first]
            for i, j in zip(x.tolist(), y.tolist()):
                if may_be_similar(*similarity(self.whole(i), self.whole(j)), self.n[i], self.n[j], percent):
                    yield self.node[i], self.node[j]


def _cross_candidates(members: DataFrame, reps: DataFrame, whole: DataFrame, percent: int, total: int) -> DataFrame:
    """(a, b): the pairs of a band group whose components differ and whose
    estimate doesn't rule the threshold out.  Small groups are dealt to bins;
    a large one is cut into blocks of about ``BLOCK_MEMBERS`` members, and
    each two of its blocks meet in a task of their own."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK_MEMBERS))
    bins = max(1, -(-total // BIN_MEMBERS))
    # 32 bits of the earlier bands' keys: two that differ agree in them with a probability of 2e-10
    short = F.transform("bands", lambda x: F.shiftright(x, 32).cast("int"))
    facts = members.join(reps.select("node", "n_shingles", "sketch", short.alias("bands")).join(whole, "node"), "node")
    dealt = (facts.withColumn("earlier", F.slice("bands", 1, F.col("band")))
             .withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))))
    place = F.when(blocks == 1, F.struct(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("group"), F.lit(0).alias("i"), F.lit(0).alias("j"))).otherwise(
        F.struct(F.col("key").alias("group"), (F.least("mine", "other") + 1).alias("i"), (F.greatest("mine", "other") + 1).alias("j")))

    def run(table: pa.Table) -> pa.Table:
        m = _Members(table)
        i, j = table.column("i")[0].as_py() - 1, table.column("j")[0].as_py() - 1
        order = np.argsort(m.key, kind="stable")
        found = []
        for group in np.split(order, np.flatnonzero(np.diff(m.key[order])) + 1):
            sides = (group, None) if i == j else (group[m.mine[group] == i], group[m.mine[group] == j])
            if len(sides[0]) and (sides[1] is None or len(sides[1])):
                found.extend(m.pairs(*sides, percent))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(np.minimum(a, b).astype(np.int64)), "b": pa.array(np.maximum(a, b).astype(np.int64))})
    columns = ["key", "node", "root", "n_shingles", "sketch", "whole", "earlier", "mine"]
    return (dealt.withColumn("place", place).select(*columns, "place.*").groupBy("group", "i", "j")
            .applyInArrow(run, "a bigint, b bigint"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs = staged(pairs, "candidates")
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            left = shingle_sets([t or "" for t in part.column("a_text").to_pylist()], shingle)
            right = shingle_sets([t or "" for t in part.column("b_text").to_pylist()], shingle)
            linked = []
            for x, y in zip(left, right):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(bool(len(x)) and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
    return staged(both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint"), "links")


def _known_id(c: str = "id") -> Column:
    return F.coalesce(F.col(c), F.lit(_NULL_ID))


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text_key, n_shingles, component_id (the least id
    reachable over links of similarity >= percent / 100, itself included),
    kept (id = component_id), and stays: true for one text of each component
    (of the row of least id, then of least text key; without ids of least
    text key), for every row with that id and text."""
    if not 80 <= percent <= 100:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    ship_package(df.sparkSession)
    # numbered once, when written: a class is known by the least number of its rows
    signed = staged(signatures(df, shingle, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signatures")
    rows = signed.select("id", "text_key", "n_shingles", "set_key")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key"))
    classes = staged(signed.groupBy("set_key").agg(F.min("row").alias("node"), least.alias("first"), F.count("*").alias("group_size")),
                     "classes")
    reps = (signed.where("n_shingles > 0").select(F.col("row").alias("node"), "id", "text_key", "n_shingles", "bands", "sketch")
            .join(classes.select("node"), "node", "left_semi"))
    reps = staged(reps, "representatives")

    members = staged(band_members(reps), "band-members")

    # texts of classes that share a band with another: all that rounds need
    wanted = reps.join(members.select("node").distinct(), "node", "left_semi").select("node", _known_id().alias("_id"), "text_key")
    texts = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID)).alias("_id"), text_key(F.col(text_col)).alias("text_key"),
                      F.col(text_col).alias("text"))
    needed = texts.join(wanted.hint("merge"), ["_id", "text_key"]).select("node", "text")
    needed = staged(needed.dropDuplicates(["node"]), "candidate-texts")      # a row may be repeated

    links, labels, order = None, None, 0
    left = members.count()
    while True:
        found = _verified(_hub_candidates(members, reps, percent, order), needed, shingle, percent)
        links = found if links is None else links.union(found)
        labels = components(links)
        members, order = _mixed(members, labels), order + 1
        # from here on only open classes, and their texts, are read
        open_nodes = staged(members.select("node").distinct(), "open-nodes")
        reps = staged(reps.join(open_nodes, "node", "left_semi"), "open-representatives")
        needed = staged(needed.join(open_nodes, "node", "left_semi"), "open-texts")
        before, left = left, members.count()
        if left == 0 or left > SETTLED * before:
            break
    found = _verified(_cross_candidates(members, reps, whole_of(needed, shingle), percent, left), needed, shingle, percent)
    labels = staged(components(links.union(found)), "labels")

    linked = labels.join(classes.select("node", "first"), "node")
    of_root = linked.groupBy("root").agg(F.min("first").alias("of_all"), F.count("*").alias("group_size"))
    labelled = join_groups(labels, staged(of_root, "components"), "root").select("node", "of_all")
    named = (classes.join(labelled, "node", "left")
             .select("set_key", "group_size", F.coalesce("of_all", "first").alias("least")))
    out = join_groups(rows, staged(named, "class-components"), "set_key")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    least = F.when(F.col("n_shingles") == 0, own).otherwise(F.col("least"))
    return (out.withColumn("least", least)
            .select("id", "text_key", "n_shingles", F.col("least.id").alias("component_id"),
                    F.col("id").eqNullSafe(F.col("least.id")).alias("kept"),
                    (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_key") == F.col("least.text_key"))).alias("stays")))


def drop_near_duplicates(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, of each component only those of its
    one text that stays: rows go by id and text, so a row that merely shares
    an id with a near copy is left alone."""
    gone, gone_text, own = (fresh(df, x) for x in ("_gone", "_gone_text", "_text_key"))
    dropped = (near_duplicates(df, shingle, percent, id_col, text_col).where(~F.col("stays"))
               .select(_known_id().alias(gone), F.col("text_key").alias(gone_text)).distinct())
    keyed = df.withColumn(own, text_key(F.col(text_col)))
    same = (F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID)) == F.col(gone)) & (F.col(own) == F.col(gone_text))
    return keyed.join(dropped, same, "left_anti").drop(own)
