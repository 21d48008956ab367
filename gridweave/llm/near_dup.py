"""Operator 7: near-duplicate groups by MinHash bands, odd sketches and exact verification.

1. Every text's distinct word shingles give a set digest, ``BANDS`` band
   hashes of ``BAND_ROWS`` MinHash values each, and an odd sketch: the MinHash
   samples folded into a bitmap by parity. Texts with equal sets become one
   *class* at once, so groups of exact copies cost one row from here on.
2. Classes that share a band meet in a bucket. Each is first paired with the
   bucket's smallest member only. A pair goes on if its sketches' XOR holds
   few enough ones for a similarity of ``SKETCH_FLOOR`` or more; then the full
   sets are intersected. The sketch only says what goes ahead: in a bucket of
   two the pair is verified in any case, in others step 3 looks again.
   The first few bands go ahead; in the others only members that are not yet
   in one component with the smallest are paired.
3. Links make components. In a bucket whose members are all in one component
   there is nothing left to link. In the others, members outside its largest
   component are compared, in blocks of bounded size, with all
   members of other components: at first only a spanning forest of the best
   estimates by sketch goes to verification, then, after those links have joined
   components, every pair that is left is verified within its block, whatever
   its sketches say. No pair within a component is ever
   made, and no bucket is gathered.

A pair at the threshold itself shares no band with probability
(1 - 0.75**5)**40, about 2 in 100,000; more similar pairs far less. Null and
empty texts, or texts without words, have an empty set and are linked with
nothing. Repeated rows are members of one class and give one result row each.
Null ids come last: a group bears one only if it has no other. Rows are told
apart by id and text, so an id may stand for several texts, or be missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Shared, Words, bloom, in_bloom, mix, shingles, signed, slices, stage, text_key, text_rows
from gridweave.llm.components import components

SHINGLE_WORDS, BANDS, BAND_ROWS, SKETCH_BITS, SKETCH_FLOOR, FIRST_BANDS, BLOCK = 5, 40, 5, 512, 0.62, 4, 256
_U = np.uint64
_SAMPLES = BANDS * BAND_ROWS


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * _SAMPLES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return (seed[:_SAMPLES] >> _U(32)).astype(np.uint32) | np.uint32(1), (seed[_SAMPLES:] >> _U(32)).astype(np.uint32)


def distinct_sets(h: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[a:z]) for a, z in zip(offs[:-1], offs[1:], strict=True)]


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minhash(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash samples (rows: permutations) of the stretches of ``h`` that begin at ``starts``."""
    x = (h >> _U(32)).astype(np.uint32)
    y = h.astype(np.uint32)
    out = np.empty((_SAMPLES, len(starts)), np.uint32)
    mult, add = _permutations()
    for i in range(_SAMPLES):
        out[i] = np.minimum.reduceat((x ^ add[i]) * mult[i] + y, starts)
    return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    """One hash for each band (columns) of each text (rows)."""
    out = np.empty((samples.shape[1], BANDS), _U)
    for b in range(BANDS):
        acc = np.full(samples.shape[1], b + 1, _U)
        for r in range(BAND_ROWS):
            acc = mix(acc * _U(0x9E3779B97F4A7C15) + samples[b * BAND_ROWS + r])
        out[:, b] = acc
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: every (permutation, value) pair flips one bit."""
    n = samples.shape[1]
    spot = mix(samples.astype(_U) + (np.arange(1, _SAMPLES + 1, dtype=_U) << _U(32))[:, None]) % _U(SKETCH_BITS)
    flat = (spot.astype(np.int64) + np.arange(n) * SKETCH_BITS).ravel()
    ones = np.bincount(flat, minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    return np.packbits(ones.astype(np.uint8), axis=1)


def most_ones(similarity: float) -> int:
    """Ones expected in the XOR of two sketches at a similarity; fewer mean more similar."""
    differing = 2 * _SAMPLES * (1 - similarity)
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * differing / SKETCH_BITS)))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ones in the XOR of aligned sketches (rows of 64-bit words)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _sketch_batches():
    """Set size, set digest, band hashes and odd sketch of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, offs = shingles(Words(part.column(1)), SHINGLE_WORDS)
                n = part.num_rows
                held = np.flatnonzero(np.diff(offs) > 0)
                sets = distinct_sets(h, offs)
                bands: list = [None] * n
                sketch: list = [None] * n
                if len(held):
                    samples = minhash(h, offs[held])
                    rows, odd = signed(band_hashes(samples)), odd_sketches(samples)
                    for k, i in enumerate(held.tolist()):
                        bands[i], sketch[i] = rows[k], odd[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), part.column(2)],
                    names=["doc_id", "n_shingles", "digest", "bands", "sketch", "key"],
                )

    return run


def _set_batches(bits):
    """The full sets of texts whose digest may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = distinct_sets(*shingles(Words(part.column(1)), SHINGLE_WORDS))
                digests = [set_digest(s) for s in sets]
                key = np.frombuffer(b"".join(d[:8] for d in digests), "<u8")
                at = np.flatnonzero(in_bloom(bits.value, key)).tolist()
                if at:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at)), pa.array([digests[i] for i in at], pa.binary()), pa.array([sets[i].tobytes() for i in at], pa.binary())],
                        names=["doc_id", "digest", "shingles"],
                    )

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Two texts are linked if their sets' similarity is at least ``percent``
    per cent. ``component_id`` is the smallest id reachable over links, the
    row's own included; ``kept`` marks the row that bears it.
    """
    out = _linked(docs, id_col, text_col, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of linked texts, that with the smallest id; of rows equal in id and text, one.

    Null ids come last, and of equal ids the text with the smaller key stays.
    Texts without words are linked with nothing and stay.
    """
    found = _linked(docs, id_col, text_col, percent)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")
    kept = found.filter("n_shingles > 0").groupBy("root").agg(one).select("one.doc_id", "one.key")
    kept = kept.unionByName(found.filter("n_shingles = 0").select("doc_id", "key").distinct())
    rows = docs.select(F.struct("*").alias("row"))  # whatever its columns are called
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    rows = rows.select("row", F.col("row").getField(id_col).alias("id"), text_key(text).alias("text_key"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "text_key"]).select("row.*")


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``doc_id, key, n_shingles, root, component_id`` for every row; rows of linked texts have one ``root``."""
    rows = text_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sketched = stage(
        rows.withColumn("key", text_key(F.col("text"))).mapInArrow(
            _sketch_batches(), f"doc_id {id_type}, n_shingles bigint, digest binary, bands array<bigint>, sketch binary, key string"
        ),
        "sketches",
    )
    # one class for each distinct set; its number holds because the table is written
    classes = stage(
        sketched.filter("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("least"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")
        ).withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    sketches = classes.select("class", "sketch")

    def close(pairs: DataFrame, most: int) -> DataFrame:
        two = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b").select("a", "b", "x", "y")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), _U).reshape(batch.num_rows, -1) for c in (2, 3))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                        pa.array(apart(x, y) <= most)
                    )

        return two.mapInArrow(run, "a bigint, b bigint")

    in_bands = classes.select("class", F.posexplode("bands").alias("no", "band"))
    size = in_bands.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("class").alias("lead"), F.bit_xor(F.xxhash64("class")).alias("mark"), F.min("no").alias("no")
    ).filter("n > 1")
    # bands that hold the same classes are one bucket
    size = size.groupBy("n", "lead", "mark").agg(F.min(F.struct("no", "band")).alias("one")).select("n", "lead", "one.*")
    buckets = stage(in_bands.drop("no").join(size, "band"), "buckets")

    wanted = classes.join(buckets.select("class").distinct(), "class", "left_semi").select("class", "digest", "least")
    bits = Shared(docs.sparkSession, bloom(wanted.select(_low_eight("digest").alias("h")), "h"))
    full = rows.mapInArrow(_set_batches(bits), f"doc_id {id_type}, digest binary, shingles binary")
    bearer = (full["digest"] == wanted["digest"]) & full["doc_id"].eqNullSafe(wanted["least"])
    sets = stage(full.join(wanted, bearer).select("class", "shingles").dropDuplicates(["class"]), "sets")

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        two = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
        return stage(two.mapInArrow(_verified(percent), "a bigint, b bigint"), tag)

    most = most_ones(SKETCH_FLOOR)
    star = buckets.filter("class != lead").select("no", "n", F.col("lead").alias("a"), F.col("class").alias("b"))
    links = verified(close(star.filter(F.col("no") < FIRST_BANDS).select("a", "b").distinct(), most), "links-first")
    root_of = components(links)
    later = star.filter((F.col("no") >= FIRST_BANDS) | (F.col("n") == 2)).groupBy("a", "b").agg(F.min("n").alias("n"))
    later = later.join(root_of.toDF("a", "ra"), "a", "left").join(root_of.toDF("b", "rb"), "b", "left")
    later = later.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "n")
    later = close(later.filter("n > 2").select("a", "b"), most).unionByName(later.filter("n = 2").select("a", "b"))
    links = stage(links.unionByName(verified(later, "links-later")), "links")
    for turn in ("best", "all"):
        found = components(links)
        best = turn == "best"
        rest = _blocks(buckets, found, sketches if best else sketches.join(sets, "class")).groupBy("band", "o", "d", "own")
        more = rest.applyInArrow(_across(most if best else None, percent), "a bigint, b bigint").distinct()
        links = stage(links.unionByName(verified(more, "links-best") if best else more), "links")
    root = components(links)

    low = classes.join(root.withColumnRenamed("id", "class"), "class", "left").select(
        "digest", "least", F.coalesce("root", "class").alias("root")
    )
    least = low.groupBy("root").agg(F.min("least").alias("component_id"))
    named = low.join(least, "root").select("digest", "root", "component_id")
    out = sketched.select("doc_id", "key", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", "n_shingles", "root", component.alias("component_id"))


def _low_eight(digest: str):
    """The first eight bytes of a digest, read as a little-endian long."""
    byte = [F.conv(F.hex(F.substring(digest, i + 1, 1)), 16, 10).cast("bigint") for i in range(8)]
    out = byte[0]
    for i in range(1, 8):
        out = out.bitwiseOR(F.shiftleft(byte[i], 8 * i))
    return out


def _blocks(buckets: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, dealt into blocks to compare.

    The members outside a bucket's largest component are cut into chunks
    ``o``; each chunk meets every chunk ``d`` of the largest component, and
    every chunk of the others. Rows of a block: the ``o`` side (``side`` 0)
    and the other (1); ``own`` marks blocks among the others.
    """
    of = buckets.join(found.withColumnRenamed("id", "class"), "class", "left").select(
        "band", "class", "n", F.coalesce("root", "class").alias("root")
    )
    per_root = of.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    mixed = per_root.groupBy("band").agg(F.max(F.struct("k", "root")).alias("top"), F.max("n").alias("n")).filter(
        "n > 2 AND top.k < n"  # of two members, the one pair has been verified
    )
    chunks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    mixed = mixed.select(
        "band", F.col("top.root").alias("main"), chunks(F.col("top.k")).alias("nd"), chunks(F.col("n") - F.col("top.k")).alias("no")
    )
    members = of.select("band", "class", "root").join(mixed, "band")
    spot = F.xxhash64("class")
    main = F.col("root") == F.col("main")
    mine = F.when(main, F.pmod(spot, F.col("nd"))).otherwise(F.pmod(spot, F.col("no"))).cast("int")
    members = members.withColumn("mine", mine).withColumn("is_main", main)
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    place = lambda o, d, own, side: F.struct(o.alias("o"), d.alias("d"), F.lit(own).alias("own"), F.lit(side).alias("side"))
    at = F.when(F.col("is_main"), each("no", lambda j: place(j, F.col("mine"), False, 1))).otherwise(
        F.concat(
            each("nd", lambda j: place(F.col("mine"), j, False, 0)),
            each("no", lambda j: place(F.least(F.col("mine"), j), F.greatest(F.col("mine"), j), True, 0)),
        )
    )
    dealt = members.select("band", "class", "root", F.inline(at))
    return dealt.join(sketches, "class")


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two full sets, as sorted 64-bit hashes, reach the similarity."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(few) < percent * len(many):
        return False
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[at] == few).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _across(most: int | None, percent: int):
    """Pairs of one block, of different components, nearest by sketch first, that still join two components.

    With ``most`` they are a spanning forest of estimates up to so many ones, to be
    verified; without it every pair is verified here, on the full sets that the
    rows bring, and only links come out.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, root, side = (table[c].to_numpy() for c in ("class", "root", "side"))
        bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), _U).reshape(len(ids), -1)
        sets = table["shingles"].to_pylist() if most is None else []
        held = np.array([len(x) for x in sets], np.int64)
        own = bool(table["own"][0].as_py())
        left = np.arange(len(ids)) if own else np.flatnonzero(side == 0)
        right = left if own else np.flatnonzero(side == 1)
        got = []
        for i in left:
            j = right[(root[right] != root[i]) & ((ids[right] > ids[i]) | (not own))]
            ones = apart(bits[j], bits[i])
            # sets of too different a size are never similar
            near = ones <= most if most is not None else 100 * np.minimum(held[j], held[i]) >= percent * np.maximum(held[j], held[i])
            got += zip(ones[near].tolist(), [int(i)] * int(near.sum()), j[near].tolist(), strict=True)
        up: dict = {}

        def top(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        a, b = [], []
        for _, i, j in sorted(got):
            x, y = top(root[i]), top(root[j])
            if x != y and (most is not None or _similar(sets[i], sets[j], percent)):
                up[x] = y
                a.append(int(min(ids[i], ids[j])))
                b.append(int(max(ids[i], ids[j])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run
