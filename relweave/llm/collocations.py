"""Phrase collocations from a weighted de Bruijn graph.

Texts are cut into pieces and these into words. The longest grams, three words, are
the edges of a graph whose nodes are their first and last two words. Edges are
counted once; everything shorter is derived: a node's count is the flow that leaves
it plus the pieces that end in it, a word's count the flow of the nodes it opens plus
the pieces it ends. Runs of nodes with one way in and one way out, through which all
their weight flows, are compacted to paths, by pointer doubling; each frequent edge
lies on exactly one path, a node inside a path has the path's weight, and only the
nodes at path ends need the flows looked up. Candidates are read off the paths.

Edges travel in parcels: a task cuts a run of text, counts its edges, and packs those
of one bucket of nodes into one compressed row. A node whose two words are both among
the HOT_WORDS of a sample is split over SALTS buckets by its next word, since only
such nodes can hold a great share of all edges. The sample decides nothing else.

Edge cases: a NULL text is empty; a NULL language is ``und``; pieces of one or two
words have no edge and count by their ends alone; repeated rows count each; an empty
table gives no row; extra columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import stored
from relweave.runtime import cut_lineage

MIN_COUNT = 10
TOP = 2000
#: Characters a task counts at once, and characters of text per bucket of edges.
RUN_CHARS = 8_000_000
BUCKET_CHARS = 4_000_000
#: Documents of the sample, their characters, and words of it that open or close split nodes.
SAMPLE_DOCS = 500
SAMPLE_CHARS = 5_000
HOT_WORDS = 64
SALTS = 64
#: Words of a path that are kept in one row.
SEGMENT = 512
_CUT = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def words_of(data: bytes) -> list[bytes]:
    r"""Words of a text, with ``\xff`` (no byte of UTF-8) where a piece ends."""
    table = bytes.maketrans(UPPER + _CUT + b"\t", LOWER + b"\n" * len(_CUT) + b" ")
    return data.translate(table).replace(b"\n", b" \xff ").split()


def hot_words(docs: DataFrame, rows: int) -> list[bytes]:
    """The commonest words of up to SAMPLE_DOCS of ``rows`` documents, which only balance the load."""
    from collections import Counter

    text = F.col("text").cast("string")
    some = docs.where(text.isNotNull() & (F.pmod(F.xxhash64(text), F.lit(max(1, rows // SAMPLE_DOCS))) == 0))
    counts: Counter = Counter()
    for row in some.select(F.substring(text, 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_DOCS).collect():
        counts.update(words_of(row.text.encode()))
    counts.pop(b"\xff", None)
    return sorted(w for w, _ in counts.most_common(HOT_WORDS))


def parcels(docs: DataFrame, buckets: int, hot: list[bytes]) -> DataFrame:
    r"""(lang, bucket, edges): counted edges of a run, one row for each bucket of nodes.

    ``edges`` is zstd over the counts (4 bytes each) behind their number, then nodes and
    then next words, each list joined by ``\n``. A piece's last two words are an edge
    without a next word; its last word is an edge of the node ``"word "``.
    """
    cut, run_chars, salts = words_of, RUN_CHARS, SALTS

    def run(batches):
        import itertools
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard

        digest, squeeze = xxhash.xxh64_intdigest, zstandard.ZstdCompressor(level=1).compress
        odd, even = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

        def counted(texts):
            number = defaultdict(itertools.count().__next__)
            number[b"\xff"] = number[b""] = 0
            number.default_factory = itertools.count(1).__next__
            tokens = cut(b"\n".join(texts) + b"\n\n")
            ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
            del tokens
            bits = max(1, len(number)).bit_length()
            words = [b"", *[w for w, i in number.items() if i]]
            if 3 * bits > 63:
                raise ValueError("too many different words in one run")
            first, second, third = ids[:-2], ids[1:-1].copy(), ids[2:].copy()
            third[second == 0] = 0
            some = first != 0
            key, n = np.unique(first[some] << 2 * bits | second[some] << bits | third[some], return_counts=True)
            mask = (1 << bits) - 1
            return words, key >> 2 * bits, key >> bits & mask, key & mask, n

        def rows(lang, texts):
            words, a, b, c, n = counted(texts)
            if not len(a):
                return
            hashes = np.array([digest(w) for w in words], np.uint64)
            node = (hashes[a] * odd ^ hashes[b]) * even
            common = np.array([w in hot_set for w in words])
            spread = common[a] & common[b]
            node += np.where(spread, hashes[c] % np.uint64(salts) + np.uint64(1), np.uint64(0)) * odd
            bucket = ((node ^ node >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # keys stay in order inside a bucket
            starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
                some = order[at:end]
                nodes = b"\n".join([words[x] + b" " + words[y] for x, y in zip(a[some].tolist(), b[some].tolist())])
                nexts = b"\n".join([words[z] for z in c[some].tolist()])
                data = len(some).to_bytes(4, "little") + n[some].astype("<u4").tobytes() + nodes + b"\n" + nexts
                yield lang, int(bucket[some[0]]), squeeze(data)

        def flush(held):
            out = [row for lang, texts in held.items() for row in rows(lang, texts)]
            for at in range(0, len(out), 256):
                lang, bucket, edges = zip(*out[at : at + 256])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(bucket, pa.int64()), pa.array(edges, pa.binary())], names=["lang", "bucket", "edges"]
                )

        hot_set, held, chars = frozenset(hot), defaultdict(list), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py().encode()
                held[lang].append(data)
                chars += len(data)
                if chars >= run_chars:
                    yield from flush(held)
                    held, chars = defaultdict(list), 0
        yield from flush(held)

    texts = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "lang string, bucket long, edges binary")


def merged(sent: DataFrame, min_count: int) -> DataFrame:
    """(lang, kind, phrase, next, n) from the parcels of each bucket.

    kind 3: edges counted ``min_count`` times or more; kind 2: flows of nodes, parts of
    them for split nodes; kind 1: parts of the flows of words.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress

        def lines(data):
            return pc.list_flatten(pc.split_pattern(pa.array([data.decode()]), "\n"))

        def summed(lang, held):
            node, nxt, n = [], [], []
            for data in held:
                data = grow(data)
                size = int.from_bytes(data[:4], "little")
                n.append(pa.array(np.frombuffer(data, "<u4", size, 4).astype(np.int64)))
                both = lines(data[4 + 4 * size :])
                node.append(both[:size]), nxt.append(both[size:])
            table = pa.table({"node": pa.chunked_array(node), "next": pa.chunked_array(nxt), "n": pa.chunked_array(n)})
            edges = table.group_by(["node", "next"]).aggregate([("n", "sum")])
            flows = edges.group_by(["node"]).aggregate([("n_sum", "sum")])
            first = pc.list_element(pc.split_pattern(flows["node"], " ", max_splits=1), 0)
            words = pa.table({"word": first, "n": flows["n_sum_sum"]}).group_by(["word"]).aggregate([("n", "sum")])
            frequent = edges.filter(pc.and_(pc.greater_equal(edges["n_sum"], min_count), pc.not_equal(edges["next"], "")))
            pairs = flows.filter(pc.invert(pc.ends_with(flows["node"], " ")))
            parts = [(3, frequent["node"], frequent["next"], frequent["n_sum"]), (2, pairs["node"], None, pairs["n_sum_sum"]), (1, words["word"], None, words["n_sum"])]
            for kind, phrase, nxt, n in parts:
                size = len(phrase)
                table = pa.table({
                    "lang": pa.repeat(pa.scalar(lang, pa.string()), size), "kind": pa.repeat(pa.scalar(kind, pa.int32()), size),
                    "phrase": phrase, "next": pa.repeat(pa.scalar("", pa.string()), size) if nxt is None else nxt, "n": n,
                })
                yield from table.combine_chunks().to_batches(max_chunksize=50_000)

        key, held = None, []
        for batch in batches:
            for lang, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != (lang, bucket):
                    if held:
                        yield from summed(key[0], held)
                    key, held = (lang, bucket), []
                held.append(data)
        if held:
            yield from summed(key[0], held)

    dealt = sent.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return dealt.mapInArrow(run, "lang string, kind int, phrase string, next string, n long")


def flows(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, kind, phrase, next, n): frequent edges (3), nodes (2) and words (1), and all words of a language (0)."""
    rows, size = docs.agg(F.count("text"), F.sum(F.length(F.col("text").cast("string")))).first()
    buckets = max(16, (size or 0) // BUCKET_CHARS)
    parts = merged(parcels(docs, int(buckets), hot_words(docs, rows)), min_count)
    total = parts.groupBy("lang", "kind", "phrase", "next").agg(F.sum("n").alias("n"))
    summed = total.where((F.col("kind") == 1) | (F.col("n") >= min_count))
    # words of all counts make up a language; rare ones are left out of the table afterwards
    counts = stored(summed.withColumn("rare", F.col("n") < min_count), "flows")
    langs = counts.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    whole = langs.select("lang", F.lit(0).alias("kind"), F.lit("").alias("phrase"), F.lit("").alias("next"), "n")
    return counts.where("not rare").drop("rare").unionByName(whole)


def compacted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths (lang, path, segment, words, weight, first_flow, last_flow) of frequent edges.

    ``edges`` has (lang, u, v, z, n), ``nodes`` (lang, node, f). A path is named by its
    first edge; long ones come in segments of SEGMENT nodes that overlap by two words.
    first_flow and last_flow are the counts of the segment's first and last node.
    """
    flow = lambda name: nodes.select("lang", F.col("node").alias(name), F.col("f").alias(f"f{name}"))
    known = stored(edges.join(flow("u"), ["lang", "u"]).join(flow("v"), ["lang", "v"]), "edges")
    into = known.where("n = fv").select("lang", F.col("v").alias("x"), F.col("u").alias("before"), F.col("fu").alias("f_before"))
    out = known.where("n = fu").select("lang", F.col("u").alias("x"), "z", F.col("n").alias("weight"), F.col("fv").alias("f_after"))
    inner = stored(into.join(out, ["lang", "x"]), "inner")
    parent = inner.select("lang", F.col("x").alias("before"), F.lit(True).alias("inside"))
    opened = inner.join(parent, ["lang", "before"], "left")
    first = F.concat(F.substring_index("before", " ", 1), F.lit(" "), "x")
    state = opened.select(
        "lang", "x", F.when(F.col("inside"), F.col("before")).alias("anchor"), F.when(F.col("inside").isNull(), first).alias("path"),
        F.when(F.col("inside"), 1).otherwise(0).cast("long").alias("at"),
    )
    # pointer doubling: a round joins every open node to its anchor's place
    state = cut_lineage(state)
    while state.where("path is null").limit(1).count():
        ahead = state.select("lang", F.col("x").alias("anchor"), F.col("anchor").alias("next_anchor"), F.col("path").alias("next_path"), F.col("at").alias("more"))
        moved = state.where("path is null").drop("path").join(ahead, ["lang", "anchor"]).select(
            "lang", "x", F.col("next_anchor").alias("anchor"), F.col("next_path").alias("path"), (F.col("at") + F.col("more")).alias("at")
        )
        state = cut_lineage(state.where("path is not null").unionByName(moved))
    placed = state.select("lang", "x", "path", "at", F.floor(F.col("at") / SEGMENT).alias("segment")).join(inner, ["lang", "x"])
    runs = placed.groupBy("lang", "path", "segment").agg(
        F.sort_array(F.collect_list(F.struct("at", "x", "z"))).alias("run"), F.min("weight").alias("weight"),
        F.min(F.when(F.col("at") == 0, F.col("f_before"))).alias("f_before"), F.max_by("f_after", "at").alias("last_flow"),
    )
    lead = F.split(F.concat_ws(" ", F.when(F.col("segment") == 0, F.substring_index("path", " ", 1)), F.col("run")[0]["x"]), " ")
    long_ = runs.select(
        "lang", "path", "segment", F.concat(lead, F.transform("run", lambda r: r["z"])).alias("words"), "weight",
        F.coalesce("f_before", "weight").alias("first_flow"), "last_flow",
    )
    inside = inner.select("lang", "x")
    lone = known.join(inside.withColumnRenamed("x", "u"), ["lang", "u"], "left_anti").join(inside.withColumnRenamed("x", "v"), ["lang", "v"], "left_anti")
    phrase = F.concat_ws(" ", "u", "z")
    short = lone.select(
        "lang", phrase.alias("path"), F.lit(0).cast("long").alias("segment"), F.split(phrase, " ").alias("words"), F.col("n").alias("weight"),
        F.col("fu").alias("first_flow"), F.col("fv").alias("last_flow"),
    )
    return long_.unionByName(short)


def candidates(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, phrase, a, first, last, head, tail): phrases no longer one outweighs.

    ``first`` and ``last`` are the outer words; ``head`` and ``tail`` the counts of a
    three-word phrase's first and last two words, NULL for two words.
    """
    size = F.size("words")
    spot = F.posexplode(F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.slice("words", i + 1, 3)))
    threes = paths.select("lang", "weight", "first_flow", "last_flow", size.alias("size"), spot.alias("i", "w")).select(
        "lang", F.array_join("w", " ").alias("phrase"), F.col("weight").alias("a"), F.col("w")[0].alias("first"), F.col("w")[2].alias("last"),
        F.when(F.col("i") == 0, F.col("first_flow")).otherwise(F.col("weight")).alias("head"),
        F.when(F.col("i") == F.col("size") - 3, F.col("last_flow")).otherwise(F.col("weight")).alias("tail"),
    )
    pairs = F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.array_join(F.slice("words", i + 1, 2), " "))
    beside = paths.select("lang", F.explode(F.array_distinct(pairs)).alias("node"), "weight").groupBy("lang", "node").agg(F.max("weight").alias("most"))
    kept = nodes.join(beside, ["lang", "node"], "left").where(F.col("most").isNull() | (2 * F.col("most") < F.col("f")))
    none = F.lit(None).cast("long")
    twos = kept.select(
        "lang", F.col("node").alias("phrase"), F.col("f").alias("a"), F.substring_index("node", " ", 1).alias("first"),
        F.substring_index("node", " ", -1).alias("last"), none.alias("head"), none.alias("tail"),
    )
    return threes.unionByName(twos)


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    square = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    product = (wide(left) * wide(right)).cast("decimal(38,0)")
    # the whole quotient: the remainder is taken off first, so that nothing is rounded
    return ((square - square % product) / product).cast("long")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words."""
    counts = cut_lineage(flows(docs, min_count))
    nodes = counts.where("kind = 2").select("lang", F.col("phrase").alias("node"), F.col("n").alias("f"))
    words = counts.where("kind = 1").select("lang", "phrase", "n")
    totals = counts.where("kind = 0").select("lang", "n")
    head = F.concat_ws(" ", F.substring_index("phrase", " ", -1), "next")
    edges = counts.where("kind = 3").select("lang", F.col("phrase").alias("u"), head.alias("v"), F.col("next").alias("z"), "n")
    paths = stored(compacted(edges, nodes), "paths")
    outer = lambda name: words.select("lang", F.col("phrase").alias(name), F.col("n").alias(f"n_{name}"))
    found = candidates(paths, nodes).join(outer("first"), ["lang", "first"]).join(outer("last"), ["lang", "last"])
    one = F.struct(
        _score(F.col("a"), F.col("n_first"), F.coalesce("tail", "n_last")).alias("score"), F.lit(1).alias("cut"),
        F.col("n_first").alias("l"), F.coalesce("tail", "n_last").alias("r"),
    )
    two = F.struct(_score(F.col("a"), F.col("head"), F.col("n_last")).alias("score"), F.lit(2).alias("cut"), F.col("head").alias("l"), F.col("n_last").alias("r"))
    best = F.when(F.col("head").isNotNull(), F.least(one, two)).otherwise(one)
    scored = found.select("lang", "phrase", "a", best.alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
