"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints
differ by at most three bits, one segment differs by at most one, and then both
have an equal variant of it with the same bit left out. The 64 variants of each
distinct fingerprint are the index; an equality join finds the candidates and
the full distance verifies them. ``deduplicated`` asks for more than three bits can
tell, five-word shingles alike by 0.8, and adds MinHash bands and an exact test.

Edge cases: a NULL or empty text has no words and fingerprint zero, and such
documents link like any others; one or two words form one shingle; rows with the
same id or text are all returned; a NULL id never becomes a component id unless
its whole component has none. Extra columns of the input are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import components, discard, linked_in_buckets, settled, stored
from relweave.llm.passages import BAND_ROWS, SHINGLE, SIMILARITY, _hashing, bands_for, similar_in_crowd
from relweave.runtime import cut_lineage

SEGMENT_BITS = 32
MAX_BITS = 3


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows (doc_id, tag, fp): majority bits of the XXH64 (seed 42) of all word shingles.

    ``tag`` is the CRC of the text, 0 for NULL.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)

        def fingerprint(text):
            words = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII space
            if not words:
                return 0
            line = b" ".join(words)
            if len(words) < shingle:
                hashes = [digest(line, 42)]
            else:
                size = np.fromiter(map(len, words), np.int64, len(words))
                end = np.cumsum(size + 1) - 1
                first = (end - size)[: len(words) - shingle + 1].tolist()
                hashes = [digest(line[a:b], 42) for a, b in zip(first, end[shingle - 1 :].tolist())]
            octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
            ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ bits for i in range(8)])
            return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])

        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "tag", "fp"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag().alias("tag"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, tag long, fp long")


def _tag():
    return F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))


def variants(fps: DataFrame) -> DataFrame:
    """Index rows (key, id): each segment with each of its bits left out once."""
    position = F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT_BITS - 1))).alias("position")
    rows = fps.select("fp", position)
    segment = F.expr("shiftrightunsigned(fp, 32 * (position div 32)) & 4294967295")
    cleared = segment.bitwiseAND(F.expr("~shiftleft(1L, cast(position % 32 as int))"))
    key = F.col("position").cast("long") * F.lit(1 << SEGMENT_BITS) + cleared
    return rows.select(key.alias("key"), F.col("fp").alias("id"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id); component_id is the smallest doc_id reachable."""
    return _labelled(docs, shingle).select("doc_id", "fp", "component_id")


def _labelled(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, tag, fp, root, component_id); root is the component's least fingerprint."""
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    index = variants(distinct)
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = settled(index.join(shared, "key").withColumn("weight", F.lit(0)))
    near = f"bit_count(a ^ b) <= {MAX_BITS}"
    roots = components(linked_in_buckets(members, lambda pairs: pairs.where(near).distinct()))
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return prints.join(named.select("fp", "root", "component_id"), "fp")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of texts whose five-word shingles have a
    Jaccard similarity of 0.8 or more, chains included: that of least doc_id, one
    without an id only if none has one, then of least text CRC; of equal such rows
    the one of least hash.

    Texts are compared with A-Z in lower case. Candidates come from the variants of
    their fingerprints and from bands of MinHashes: at a similarity of 0.8 fingerprints
    differ by some ten bits, which no index of one-bit variants finds, while the bands
    miss one pair in a hundred. Every link is verified. A text of fewer than five words
    is one shingle; NULL and wordless texts are alike. Equal texts are compared once.
    """
    texts = _lowered(docs)
    prints = stored(_sketches(texts).dropDuplicates(["id"]), "sketches")
    members = stored(_candidates(prints), "members")
    sets = stored(_shingle_sets(texts.join(members.select("id").distinct(), "id", "left_semi")).dropDuplicates(["id"]), "sets")

    def alike(pairs):
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        enough = common >= SIMILARITY * (F.size("x") + F.size("y") - common) - 1e-9
        return pairs.distinct().join(left, "a").join(right, "b").where(enough).select("a", "b")

    roots = components(linked_in_buckets(members, alike, lambda ids: similar_in_crowd(ids.join(sets, "id"))))
    none = F.col("doc_id").isNull()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag().alias("tag"), _lower_id().alias("id"))
    own = own.groupBy("id").agg(F.min(F.struct(none, "doc_id", "tag")).alias("first"))
    first = own.join(roots, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    keep = cut_lineage(first.select(F.col("first.doc_id").alias("__id"), F.col("first.tag").alias("__tag")))
    discard(prints, members, sets)
    rows = docs.withColumn("__own", _tag()).join(
        keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__tag")), "left_semi"
    )
    order = Window.partitionBy("doc_id", "__own").orderBy("__tie")
    return (
        rows.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        .withColumn("__nth", F.row_number().over(order))
        .where("__nth = 1")
        .drop("__tie", "__nth", "__own")
    )


def _lower():
    return F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _lower_id():
    return F.xxhash64(_lower())


def _lowered(docs: DataFrame) -> DataFrame:
    """(id, text): the texts in lower case; equal ones have equal ids."""
    return docs.select(_lower_id().alias("id"), _lower().alias("text"))


def _shingle_hashes():
    """Function of task code: the 64-bit hashes of a text's five-word shingles."""
    split, _, shingle = _hashing()
    size = SHINGLE

    def of(text):
        import numpy as np
        import xxhash

        data = text.encode()
        hashes = split(data)
        if len(hashes) >= size:
            return shingle(hashes)
        return np.array([xxhash.xxh64_intdigest(b" ".join(data.split()))], np.uint64)

    return of


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, fp, keys): fingerprint and one MinHash key a band."""
    hashed, rows_of, bands = _shingle_hashes(), BAND_ROWS, bands_for()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
        rng = np.random.default_rng(8)
        factor = rng.integers(1, 2**32, rows_of * bands, dtype=np.uint32) | np.uint32(1)
        mask = rng.integers(0, 2**32, rows_of * bands, dtype=np.uint32)

        def fingerprint(s):
            octets = s.astype(">u8").view(np.uint8).reshape(-1, 8)
            ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ bits for i in range(8)])
            return int(np.packbits(2 * ones > len(s)).view(">i8")[0])

        def table(ids, fps, sets):
            values = np.concatenate(sets)
            starts = np.cumsum([0, *map(len, sets[:-1])])
            keys = np.zeros((bands, len(sets)), np.uint64)
            for i in range(rows_of * bands):
                x = (values ^ mask[i]) * factor[i]
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                low = np.minimum.reduceat(x ^ (x >> np.uint32(14)), starts)
                band = i // rows_of
                keys[band] = (keys[band] ^ low.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)
            ends = pa.array(np.arange(len(sets) + 1) * bands, pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.array(keys.T.ravel().view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), listed], names=["id", "fp", "keys"])

        for batch in batches:
            ids, fps, sets, held = [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = hashed(text.as_py())
                ids.append(key)
                fps.append(fingerprint(s))
                sets.append((s >> np.uint64(32)).astype(np.uint32))
                held += len(s)
                if held > 200_000:
                    yield table(ids, fps, sets)
                    ids, fps, sets, held = [], [], [], 0
            if ids:
                yield table(ids, fps, sets)

    return texts.mapInArrow(run, "id long, fp long, keys array<long>")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles): the distinct hashes, cut to 32 bits, of each text's shingles."""
    hashed = _shingle_hashes()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def table(ids, sets):
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            values = pa.array(np.concatenate(sets).astype(np.uint32).view(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, values)], names=["id", "shingles"])

        for batch in batches:
            ids, sets, held = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(key)
                sets.append(np.unique(hashed(text.as_py()) >> np.uint64(32)))
                held += len(sets[-1])
                if held > 500_000:
                    yield table(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield table(ids, sets)

    return texts.mapInArrow(run, "id long, shingles array<int>")


def _candidates(prints: DataFrame) -> DataFrame:
    """(key, id, weight): keys that several texts share. The variants of a fingerprint
    stand for its least text, which all texts of that fingerprint meet under one key."""
    def shared(index):
        many = index.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
        return index.join(many, "key")

    bands = shared(prints.select(F.explode("keys").alias("key"), "id"))
    equal = shared(prints.select(F.xxhash64("fp").alias("key"), "id"))
    one = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("text")))
    near = shared(variants(one)).join(one, F.col("id") == F.col("fp")).select("key", F.col("text").alias("id"))
    return bands.unionByName(equal).unionByName(near).distinct().withColumn("weight", F.lit(0))
