"""Passages repeated across documents, by paragraph MinHash banding.

Paragraphs are the lines of a text of at least MIN_WORDS words. Their five-word
shingles are MinHashed, bands are tuned for a recall of at least 0.99 at the
similarity threshold, paragraphs that collide in a band are joined and verified
by the exact Jaccard similarity of their 32-bit shingle hashes, and components of
verified pairs are removed
together. A passage may also repeat inside otherwise different paragraphs. So
texts are cut a second time, by content: a passage of PASSAGE_WORDS words starts
at each shingle whose hash is least among WINNOW neighbours. Any run of
PASSAGE_WORDS + WINNOW - 1 = 47 equal words holds such a passage in both texts.
These overlap, so near-equal ones come in multitudes; they count as equal only if
the 64-bit hash of all their words is. Shared picks of such a run lie at most
WINNOW words apart and at most WINNOW - 1 from its ends, so each shared passage is
extended word by word, by at most WINNOW - 1 to either side, as far as any document
of smaller id that has the passage goes on alike. Together they cover the whole run.

The document of least doc_id keeps a repeated passage; it is removed from the
others. Repeats inside one document stay.

Edge cases: NULL and short texts hold no passage; rows without a doc_id take no
part and stay as they are; rows that share a doc_id are one document, whatever
their texts; equal passages stand in one group however common they are, and no
pair of copies is formed; extra columns are carried along by ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import components, discard, linked_in_buckets, settled, stored

SHINGLE = 5
MIN_WORDS = 20
PASSAGE_WORDS = 20
WINNOW = 28
SIMILARITY = 0.8
RECALL = 0.99
#: Lengths of surroundings that are tried together.
BLOCK = 7
#: Rows of a band: four make chance collisions of half-alike paragraphs rare.
BAND_ROWS = 4


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """Fewest bands of ``rows`` rows that find pairs at the threshold with the wanted recall."""
    bands, missed = 1, 1 - similarity**rows
    while 1 - missed**bands < recall:
        bands += 1
    return bands


def _hashing():
    """Functions of task code, made anew so that they travel with it: (split, runs, shingle).

    ``split`` hashes a text's words; ``runs`` gives a function of (starts, ends) that hashes
    runs of words from running sums, so that a run costs the same at any length; ``shingle``
    hashes all five-word shingles.
    """
    size, base = SHINGLE, 0x9E3779B97F4A7C15
    factors = {}  # powers of the base and of its inverse, for the longest text so far

    def split(data):
        import numpy as np
        import xxhash

        words = data.split()
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def runs(hashes):
        import numpy as np

        n = len(hashes)
        if factors.get("n", -1) < n:
            for name, x in (("base", base), ("inverse", pow(base, -1, 1 << 64))):
                factors[name] = np.full(2 * n + 1, x, np.uint64)
                factors[name][0] = 1
                factors[name] = factors[name].cumprod()
            factors["n"] = 2 * n
        up, sums = factors["base"], np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * factors["inverse"][:n], out=sums[1:])

        def of(starts, ends):
            x = (sums[ends] - sums[starts]) * up[ends]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
            return x ^ (x >> np.uint64(29))

        return of

    def shingle(hashes, of=None):
        import numpy as np

        starts = np.arange(len(hashes) - size + 1)
        return (of or runs(hashes))(starts, starts + size)

    return split, runs, shingle


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, first, n, h, lcls, rcls, lsize, rsize, keys) of all passages and paragraphs.

    ``first`` and ``n`` count words; ``h`` hashes the words; ``tag`` is the text's CRC.
    A passage has the hashes lcls and rcls of itself with its lsize and rsize, up to
    WINNOW - 1, words to the left and right, and no keys. A paragraph has one key a band.
    """
    span, near, least, reach = PASSAGE_WORDS, WINNOW, MIN_WORDS, WINNOW - 1
    size, rows_of, bands = SHINGLE, BAND_ROWS, bands_for()
    split, runs, shingle = _hashing()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        odd, even = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
        rng = np.random.default_rng(5)
        factor = rng.integers(1, 2**32, rows_of * bands, dtype=np.uint32) | np.uint32(1)
        shift = rng.integers(0, 2**32, rows_of * bands, dtype=np.uint32)
        kinds = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("h", pa.int64()),
                           ("lcls", pa.int64()), ("rcls", pa.int64()), ("lsize", pa.int8()), ("rsize", pa.int8()), ("keys", pa.list_(pa.int64()))])

        def around(of, n, at, h):
            """lcls, rcls, lsize, rsize of the passages at ``at`` in a text of ``n`` words."""
            lsize, rsize = np.minimum(at, reach), np.minimum(n - at - span, reach)
            def whole(words, sizes, side):
                x = (h * odd + words) * even + sizes.astype(np.uint64) * np.uint64(2) + np.uint64(side)
                x = (x ^ (x >> np.uint64(31))) * odd
                return x ^ (x >> np.uint64(29))
            return whole(of(at - lsize, at), lsize, 0), whole(of(at + span, at + span + rsize), rsize, 1), lsize, rsize

        def cut(text):
            """Passages (first, h, lcls, rcls, lsize, rsize) and paragraphs (first, n, h, shingles)."""
            data = text.encode()
            hashes = split(data)
            n = len(hashes)
            if n < least:
                return None, []
            of = runs(hashes)
            s = shingle(hashes, of)
            count, found = len(s), None
            if n >= span:
                if count > near:
                    at = np.lib.stride_tricks.sliding_window_view(s, near).argmin(axis=1) + np.arange(count - near + 1)
                    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
                else:
                    at = np.array([s.argmin()])
                at = at[at + span <= n]
                h = of(at, at + span)
                found = at, h, *around(of, n, at, h)
            lines, first = [], 0
            for line in data.split(b"\n"):
                own = line.split()
                m = len(own)
                if m >= least:
                    lines.append((first, m, digest(b" ".join(own), 1), (s[first : first + m - size + 1] >> np.uint64(32)).astype(np.uint32)))
                first += m
            return found, lines

        def signatures(sets):
            """Band keys of each paragraph, as one flat list."""
            values = np.concatenate(sets)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
            keys = np.zeros((bands, len(sets)), np.uint64)
            for i in range(rows_of * bands):
                x = values * factor[i] + shift[i]
                x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
                low = np.minimum.reduceat(x ^ (x >> np.uint32(13)), starts).astype(np.uint64)
                keys[i // rows_of] = (keys[i // rows_of] ^ low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i // rows_of)
            return keys.T.ravel()

        def tables(rows):
            cuts = [(doc, tag, found) for doc, tag, (found, _) in rows if found is not None and len(found[0])]
            column = lambda x, kind: pa.array(np.concatenate(x).astype(kind))
            hashed = lambda x: pa.array(np.concatenate(x).view(np.int64))
            if cuts:
                sizes = [len(f[0]) for _, _, f in cuts]
                k, none = sum(sizes), pa.nulls(sum(sizes), kinds.field("keys").type)
                at, h, lcls, rcls, lsize, rsize = zip(*(f for _, _, f in cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([d for d, _, _ in cuts], sizes), pa.int64()), pa.array(np.repeat([t for _, t, _ in cuts], sizes), pa.int64()),
                     column(at, np.int32), pa.array(np.full(k, span, np.int32)), hashed(h), hashed(lcls), hashed(rcls),
                     column(lsize, np.int8), column(rsize, np.int8), none], schema=kinds)
            lines = [(doc, tag, *x) for doc, tag, (_, own) in rows for x in own]
            if lines:
                docs, tags, firsts, ns, hs, sets = zip(*lines)
                keys = pa.array(signatures(sets).view(np.int64))
                ends = pa.array(np.arange(len(lines) + 1) * bands, pa.int32())
                none, small = pa.nulls(len(lines), pa.int64()), pa.nulls(len(lines), pa.int8())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(firsts, pa.int32()), pa.array(ns, pa.int32()),
                     pa.array(np.array(hs, np.uint64).view(np.int64)), none, none, small, small, pa.ListArray.from_arrays(ends, keys)], schema=kinds)

        for batch in batches:
            rows, chars = [], 0
            for doc, tag, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = text.as_py()
                rows.append((doc.as_py(), tag.as_py(), cut(text)))
                chars += len(text)
                if chars > 2_000_000:
                    yield from tables(rows)
                    rows, chars = [], 0
            if rows:
                yield from tables(rows)

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long"), F.crc32(F.col("text").cast("binary")).alias("tag"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, tag long, first int, n int, h long, lcls long, rcls long, lsize byte, rsize byte, keys array<long>")


def shingles(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, shingles): the distinct 32-bit shingle hashes of each line (id, doc_id, tag, first, n)."""
    split, _, shingle = _hashing()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def table(ids, sets):
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            values = pa.array(np.concatenate(sets).astype(np.uint32).view(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, values)], names=["id", "shingles"])

        for batch in batches:
            ids, sets, held = [], [], 0
            for text, asked in zip(batch.column(0), batch.column(1)):
                hashes = split(text.as_py().encode())
                for x in asked.as_py():
                    ids.append(x["id"])
                    sets.append(np.unique(shingle(hashes[x["first"] : x["first"] + x["n"]]) >> np.uint64(32)))
                    held += len(sets[-1])
                if held > 500_000:
                    yield table(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield table(ids, sets)

    return _with_text(docs, lines, ["id", "first", "n"]).mapInArrow(run, "id long, shingles array<int>")


def similar_in_crowd(rows: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of different roots among (id, root, shingles).

    Exact. Ordered by rarity, two similar sets share one of the first
    n - ceil(similarity n) + 1 shingles of each, so what many paragraphs have in
    common does not bring them together. Shingles that one paragraph alone has
    count as differences before any set is compared. A pair is compared once, at
    the least of the shingles that bring it together, and leaves the join only if
    it is similar.
    """
    rows = rows.repartition("id")  # settled members come in few parts
    tokens = rows.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("k", "s"))
    keep = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1
    ranked = tokens.withColumn("k", F.count("*").over(Window.partitionBy("s"))).withColumn("nth", nth)
    heads = ranked.groupBy("id", "n").agg(
        F.sum((F.col("k") == 1).cast("int")).alias("own"),
        F.sort_array(F.collect_list(F.when((F.col("nth") <= keep) & (F.col("k") > 1), F.col("s")))).alias("head"),
    ).where((F.size("head") > 0) & (F.col("own") < keep))
    told = settled(rows.join(heads, "id"))
    spread = told.select("*", F.explode("head").alias("s"))
    side = lambda x: spread.select("s", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "root", "n", "own", "head", "shingles")])
    size = F.col("a_n") + F.col("b_n")
    differ = (1 - SIMILARITY) / (1 + SIMILARITY) * size + 1e-9  # most elements that only one of two similar sets has
    first = F.col("s") == F.array_min(F.array_intersect("a_head", "b_head"))
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    alike = common >= SIMILARITY * (size - common) - 1e-9
    cheap = (F.col("a_root") < F.col("b_root")) & (F.abs(F.col("a_n") - F.col("b_n")) <= differ) & (F.col("a_own") + F.col("b_own") <= differ)
    met = side("a").join(side("b").withColumnRenamed("s", "t"), (F.col("s") == F.col("t")) & cheap & first & alike)
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _with_text(docs: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """(text, asked): each distinct text with its rows of ``asked`` (doc_id, tag, ...) as structs."""
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("text").cast("binary")).alias("tag"), F.col("text").cast("string").alias("text")
    )
    lists = asked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*columns)).alias("asked"))
    once = texts.join(lists.select("doc_id", "tag"), ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    return once.join(lists, ["doc_id", "tag"]).select("text", "asked", "doc_id", "tag")


def beginnings(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(cls, least, keys): the j-th key hashes the first j words beside the seed's passage.

    ``seeds`` has (doc_id, tag, first, left, side, cls), one row per class.
    """
    span, reach = PASSAGE_WORDS, WINNOW - 1

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        def table(classes, least, keys, sizes):
            values = pa.array(np.array(keys, np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array(least, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], names=["cls", "least", "keys"]
            )

        for batch in batches:
            classes, least, keys, sizes = [], [], [], [0]
            for text, asked, doc in zip(*(batch.column(i) for i in range(3))):
                doc, words = doc.as_py(), text.as_py().encode().split()
                for s in asked:
                    s = s.as_py()
                    at = s["first"]
                    beside = words[max(0, at - reach) : at][::-1] if s["left"] else words[at + span : at + span + reach]
                    running = xxhash.xxh64(s["side"].to_bytes(8, "little", signed=True))
                    for word in beside:
                        running.update(word + b" ")
                        keys.append(running.intdigest())
                    classes.append(s["cls"]), least.append(doc), sizes.append(len(keys))
                    if len(keys) > 200_000:
                        yield table(classes, least, keys, sizes)
                        classes, least, keys, sizes = [], [], [], [0]
            if classes:
                yield table(classes, least, keys, sizes)

    return _with_text(docs, seeds, ["first", "left", "side", "cls"]).mapInArrow(run, "cls long, least long, keys array<long>")


def reached(starts: DataFrame) -> DataFrame:
    """(cls, j, lo): most words j beside its passage that a class of ``starts`` (cls, least, keys)
    shares with one of smaller document, and the least such document.

    Sharing j words means sharing fewer, so the first word of each block of lengths is
    tried first; then lengths inside a block, by the classes that share its first
    word with one whose answer lies there.
    """
    lengths = list(range(0, WINNOW - 1, BLOCK))
    shared = lambda rows: rows.groupBy("key").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi").drop("hi")
    firsts = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda b: F.struct(b.alias("b"), F.get("keys", b).alias("key"))), lambda x: x["key"].isNotNull())
    tried = starts.select("cls", "least", F.explode(firsts).alias("x")).select("cls", "least", "x.b", "x.key")
    met = stored(tried.join(shared(tried), "key"), "met")
    lies = met.where("lo < least").groupBy("cls").agg(F.max_by("key", "b").alias("key"))
    blocks = met.join(lies.select("key").distinct(), "key", "left_semi").select("cls", "b")
    inside = F.posexplode(F.slice("keys", F.col("b") + 1, BLOCK))
    steps = starts.join(blocks, "cls").select("cls", "least", "b", inside.alias("i", "key"))
    steps = stored(steps.select("cls", "least", (F.col("b") + F.col("i") + 1).alias("j"), "key"), "steps")
    found = stored(steps.join(shared(steps), "key").where("lo < least").groupBy("cls").agg(F.max("j").alias("j"), F.max_by("lo", "j").alias("lo")), "reached")
    discard(met, steps)
    return found


def extensions(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc_id, place, first, n, kept_doc_id): cuts with what equals a document of smaller id beside them.

    Cuts with equal words on a side are one class, which its least document keeps;
    where a passage has several classes, one member of each has its words fetched and
    meets the others by the hashes of all its beginnings.
    """
    side = lambda left, cls, size: cuts.select("h", "doc_id", "place", F.lit(left).alias("left"), F.col(cls).alias("cls"), F.col(size).alias("size"))
    sides = side(True, "lcls", "lsize").unionByName(side(False, "rcls", "rsize"))
    least = stored(sides.groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min_by("place", "doc_id").alias("place"), F.min("h").alias("h"), F.min("left").alias("left")), "classes")
    mixed = least.groupBy("h", "left").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("h", "left")
    seeds = least.join(mixed, ["h", "left"]).select(
        F.col("least").alias("doc_id"), *_at("place"), "left", F.xxhash64("h", "left").alias("side"), "cls")
    starts = stored(beginnings(docs, seeds), "starts")
    common = reached(starts)
    discard(starts)
    told = sides.join(least.select("cls", "least").join(common, "cls", "left"), "cls")
    copy = F.col("doc_id") > F.col("least")
    more = told.withColumn("more", F.when(copy, F.col("size")).otherwise(F.col("j"))).where("more > 0")
    tag, first = _at("place")
    out = stored(more.select(
        "doc_id", tag, (first - F.when(F.col("left"), F.col("more")).otherwise(0)).cast("int").alias("first"),
        (F.col("more") + PASSAGE_WORDS).cast("int").alias("n"), F.when(copy, F.col("least")).otherwise(F.col("lo")).alias("kept_doc_id"),
    ), "spans")
    discard(least, common)
    return out


def _at(place: str) -> tuple:
    """tag and first of a place, which holds both in one number."""
    return F.shiftrightunsigned(place, 32).alias("tag"), F.expr(f"cast({place} & 4294967295 as int)").alias("first")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, first, n, kept_doc_id) of every passage to remove; spans may overlap.

    Passages are done, and their tables gone, before paragraphs are compared.
    """
    all_units = stored(units(docs), "units")
    place = F.shiftleft(F.col("tag"), 32).bitwiseOR(F.col("first").cast("long")).alias("place")
    cut = all_units.where("keys is null").select("h", "doc_id", place, "lcls", "rcls", "lsize", "rsize")
    owners = cut.groupBy("h").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last"))
    owners = settled(owners.where("kept_doc_id < last").drop("last"))  # on its own, so that AQE may split a hot passage
    shared_cuts = stored(cut.join(owners, "h"), "cuts")
    lines = stored(all_units.where("keys is not null").select(F.col("h").alias("id"), "doc_id", "tag", "first", "n", "keys"), "lines")
    discard(all_units)
    beside = extensions(docs, shared_cuts)
    exact = shared_cuts.where("doc_id != kept_doc_id").select("doc_id", *_at("place"), F.lit(PASSAGE_WORDS).alias("n"), "kept_doc_id")
    exact = stored(exact.unionByName(beside), "exact")
    discard(shared_cuts, beside)

    index = lines.select("id", F.explode("keys").alias("key"))
    shared = index.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    weights = lines.groupBy("id").agg(F.count("*").alias("weight"))
    members = stored(index.join(shared, "key").distinct().join(weights, "id"), "members")
    wanted = members.select("id").distinct()
    places = lines.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min_by(place, "doc_id").alias("place"), F.min("n").alias("n"))
    sets = stored(shingles(docs, places.join(wanted, "id", "left_semi").select("id", "doc_id", *_at("place"), "n")), "shingles")

    def alike(pairs):
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        enough = common >= SIMILARITY * (F.size("x") + F.size("y") - common) - 1e-9
        return pairs.distinct().join(left, "a").join(right, "b").where(enough).select("a", "b")

    roots = components(linked_in_buckets(members, alike, lambda ids: similar_in_crowd(ids.join(sets, "id"))))
    groups = lines.groupBy("id").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    named = settled(groups.join(roots, F.col("id") == F.col("node"), "left").select("id", "lo", "hi", F.coalesce("root", "id").alias("root")))
    clusters = named.groupBy("root").agg(F.min("lo").alias("kept_doc_id"), F.max("hi").alias("last")).where("kept_doc_id < last")
    owners = named.join(clusters, "root").select("id", "kept_doc_id")
    near = lines.drop("keys").join(owners, "id").where("doc_id != kept_doc_id").select("doc_id", "tag", "first", "n", "kept_doc_id")
    near = stored(near, "near")
    discard(members, sets, lines)
    return exact.unionByName(near)


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, first_word, end_word, kept_doc_ids): disjoint spans to remove, in words."""
    spans = repeated(docs).withColumn("end", F.col("first") + F.col("n"))
    order = Window.partitionBy("doc_id", "tag").orderBy("first", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("first") > before).cast("int"), F.lit(1))
    spans = spans.groupBy("doc_id", "tag", "first", "end").agg(F.collect_set("kept_doc_id").alias("kept"))
    runs = spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    return runs.groupBy("doc_id", "tag", "run").agg(
        F.min("first").alias("first_word"), F.max("end").alias("end_word"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("kept")))).alias("kept_doc_ids"),
    ).drop("run")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages; a document with no word left goes."""
    spans = removals(docs).groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(
        F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias("__spans")
    )
    own = F.crc32(F.col("text").cast("binary"))
    joined = docs.withColumn("__own", own).join(
        spans, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__own") == F.col("__tag")), "left"
    ).select(*[F.col(f"`{c}`") for c in docs.columns], "__spans")
    columns = docs.columns

    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^ \t\n\x0b\x0c\r]+")

        def without(text, spans):
            places = [m.span() for m in word.finditer(text)]
            parts, at = [], 0
            for s in spans:
                parts.append(text[at : places[s["first_word"]][0]])
                at = places[s["end_word"] - 1][1]
            parts.append(text[at:])
            left = "".join(parts)
            return "\n".join(x for x in left.split("\n") if word.search(x)) or None

        for batch in batches:
            texts, keep = [], []
            for text, spans in zip(batch.column("text"), batch.column("__spans")):
                text, spans = text.as_py(), spans.as_py()
                if spans:
                    text = without(text, spans)
                texts.append(text)
                keep.append(not spans or text is not None)
            out = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)
