"""Token ids in shards, each one compressed file that holds a wavelet matrix.

Documents are range-split in ascending doc_id order, encoded, and written shard
by shard. A shard file has a header, document ids and lengths, and one bit-plane
per bit of a token id with a directory of counts, so that ``Shard`` can read the
token at a place, count a token in a range and find its occurrences without
unpacking all ids. Bit-planes are stored under zstd where that saves space.

Writers may be lost or doubled: every attempt writes files of its own name, and
only those listed by the attempt whose rows Spark keeps are read.

Edge cases: a NULL text is an empty one and holds the end id alone; NULL ids sort
first; rows that repeat an id are all kept, in order of their text's hash; an
empty table gives no shard and no row; extra columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relweave.llm.common import stored, worker_state
from relweave.runtime import cut_lineage, scratch_path

#: Tokens after which a writer closes its shard; a document is never split.
SHARD_TOKENS = 4_000_000
RUN_CHARS = 4_000_000
END_ID = 0
MAGIC = b"WVMX1\0"
#: Bits per entry of the rank directory.
BLOCK = 4096
#: Marks that may close a word.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Units a worker keeps; beyond, those of a run are learnt for the run alone.
KEEP_UNITS = 600_000


class TextEncoder:
    """Library encoding with a memory for units between single spaces.

    A space between two non-space characters always opens a token, so a text cut
    there encodes piecewise; new units go to the library together. Texts with
    other runs of white space around a space go to the library whole, and so do
    texts that hold the string of an added token, which may reach over a cut.
    """

    def __init__(self, vocabulary: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        size = self.library.get_vocab_size()
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.bits = max(1, (size - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        # the byte-level pattern ends a token between a letter and such marks
        steps = json.loads(self.library.to_str())
        self.cuts_marks = steps["normalizer"] is None and (steps["pre_tokenizer"] or {}).get("type") == "ByteLevel" and bool(
            steps["pre_tokenizer"].get("use_regex", True)
        )
        self.units: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        import numpy as np

        ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, self.kind).tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes | None]:
        """Ids of each word behind a space; None if the cut would not be safe.

        Where the vocabulary cuts between a letter and closing marks anyway, letters and
        marks are learnt apart, once for all words.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.cuts_marks or not words:
            return self._learnt(words)
        every = pa.array(words, pa.string())
        stems = pc.utf8_rtrim(every, MARKS)
        lettered = pc.utf8_is_alpha(stems)
        known = self._learnt(every.filter(pc.invert(lettered)).to_numpy(zero_copy_only=False).tolist())
        whole = every.filter(lettered)
        stems = stems.filter(lettered).dictionary_encode()
        names = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._learnt([w for w in names if w not in self.units])
        ids = [found[w] if w in found else self.units[w] for w in names]
        marks = pc.utf8_slice_codeunits(whole, 0, 0)
        size = pc.subtract(pc.utf8_length(whole), pc.utf8_length(stems.cast(pa.string())))
        for n in pc.unique(size).to_pylist():
            if n:
                chosen = pc.equal(size, n)
                marks = pc.if_else(chosen, pc.utf8_slice_codeunits(whole, -n), marks)
        marks = marks.dictionary_encode()
        closing = marks.dictionary.to_pylist()
        self.open_with([m for m in closing if m])
        ends = [self.heads[m] if m else b"" for m in closing]
        pairs = zip(stems.indices.to_numpy().tolist(), marks.indices.to_numpy().tolist())
        known.update(zip(whole.to_numpy(zero_copy_only=False).tolist(), [ids[i] + ends[j] for i, j in pairs]))
        return known

    def _learnt(self, words) -> dict[str, bytes | None]:
        import numpy as np

        plain = [w for w in words if w and w.strip() == w]
        known: dict[str, bytes | None] = dict.fromkeys(words) if len(plain) < len(words) else {}
        step = self.kind.itemsize
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids)
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) != len(some):
                raise ValueError("a token crosses a space")
            data = ids.astype(self.kind).tobytes()
            begins = (cut * step).tolist()
            known.update(zip(some, [data[x:y] for x, y in zip(begins, [*begins[1:], len(data)])]))
        return known

    def open_with(self, heads) -> None:
        """Learns first words, which have no space before them, in one call of the library."""
        import numpy as np

        new = list(set(heads).difference(self.heads))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for head, found in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)):
                self.heads[head] = np.array(found.ids, self.kind).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: its words are numbered by Arrow, each different word is
        looked up or learnt once, and ids are gathered by word number."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        heads, rests = [], []
        for text in texts:
            head, space, rest = text.partition(" ")
            # without a safe head the text goes to the library whole
            heads.append(None if not head or head[-1].isspace() or self.added.search(text) else head)
            rests.append(rest if space and heads[-1] else None)
        if len(self.heads) > KEEP_UNITS:
            self.heads.clear()
        self.open_with([h for h in heads if h])
        lists = pc.split_pattern(pa.array(rests, pa.string()), " ")
        numbered = lists.flatten().dictionary_encode()
        words, number = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        new = self.learn([w for w in words if w not in self.units])
        if len(self.units) < KEEP_UNITS:
            self.units.update(new)
            new = {}
        ids = [new[w] if w in new else self.units[w] for w in words]
        cut = np.array([x is not None for x in ids] or [True])
        sizes = np.array([len(x) if x else 0 for x in ids] or [0]) // self.kind.itemsize
        table = np.frombuffer(b"".join([x for x in ids if x]), self.kind)
        firsts = np.cumsum(sizes) - sizes
        each = sizes[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        tokens = table[np.repeat(firsts[number] - ends[:-1], each) + np.arange(ends[-1])]
        unsafe = np.concatenate([[0], np.cumsum(~cut[number])])
        places = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = []
        for text, head, a, b in zip(texts, heads, places[:-1].tolist(), places[1:].tolist()):
            if head is None or unsafe[a] < unsafe[b]:
                out.append(self.whole(text) if text else b"")
            else:
                out.append(self.heads[head] + tokens[ends[a] : ends[b]].tobytes())
        return out


def pack(ids, bits: int, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """Shard file of an id array and its documents."""
    import numpy as np
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    header = {"n": len(ids), "bits": bits, "docs": len(doc_ids), "planes": []}
    sections = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes(),
        np.array(lengths, "<u4").tobytes(),
    ]
    header["sizes"] = [len(s) for s in sections]
    current = ids
    for level in range(bits - 1, -1, -1):
        ones = (current >> level & 1).astype(bool)
        plane = np.packbits(ones)
        padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(plane)] = plane
        counts = np.bitwise_count(padded.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        directory = np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes()
        raw = padded.tobytes()
        small = squeeze(raw)
        if len(small) > 0.95 * len(raw):
            small = raw
        header["planes"].append([len(ids) - int(counts.sum()), len(raw), len(small), len(directory)])
        sections += [small, directory]
        current = np.concatenate([current[~ones], current[ones]])
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


class Shard:
    """Reader of one shard file."""

    def __init__(self, data: bytes):
        import numpy as np
        import zstandard

        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        at = len(MAGIC) + 4
        size = struct.unpack("<I", data[len(MAGIC) : at])[0]
        head = json.loads(data[at : at + size])
        at += size
        self.n, self.bits = head["n"], head["bits"]
        a, b, c = head["sizes"]
        void = np.unpackbits(np.frombuffer(data, np.uint8, b, at + a), count=head["docs"])
        ids = np.frombuffer(data, "<i8", head["docs"], at).tolist()
        self.doc_ids = [None if v else d for d, v in zip(ids, void.tolist())]
        self.lengths = np.frombuffer(data, "<u4", head["docs"], at + a + b)
        at += a + b + c
        grow = zstandard.ZstdDecompressor().decompress
        self.zeros, self.planes, self.directories = [], [], []
        for zeros, raw, small, entries in head["planes"]:
            plane = data[at : at + small]
            at += small
            plane = plane if small == raw else grow(plane, max_output_size=raw)
            self.zeros.append(zeros)
            self.planes.append(np.frombuffer(plane, np.uint8))
            self.directories.append(np.frombuffer(data, "<u4", entries // 4, at))
            at += entries

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        import numpy as np

        plane, block = self.planes[level], i // BLOCK
        total = int(self.directories[level][block])
        first, last = block * (BLOCK // 8), i >> 3
        total += int(np.bitwise_count(plane[first:last]).sum())
        return total + (int(plane[last]) >> (8 - (i & 7))).bit_count() if i & 7 else total

    def _place(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        import numpy as np

        ones = self.directories[level].astype(np.int64)
        counts = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        first = block * (BLOCK // 8)
        flags = np.unpackbits(self.planes[level][first : first + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(flags == bit)[k - int(counts[block])])

    def token(self, i: int) -> int:
        """Token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, stop)
            if token >> (self.bits - 1 - level) & 1:
                start, stop = zeros + a, zeros + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token at places start to stop."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        if token >> self.bits:
            raise IndexError(k)
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._place(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self):
        """All ids at once, by undoing the planes from the last to the first."""
        import numpy as np

        current = np.zeros(self.n, "<u2" if self.bits <= 16 else "<u4")
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            zeros = self.zeros[level]
            before = np.empty_like(current)
            before[~ones] = current[:zeros]
            before[ones] = current[zeros:] | current.dtype.type(1 << (self.bits - 1 - level))
            current = before
        return current


def write_shards(docs: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Writes all documents below ``folder``; rows (part, nth, name, n_docs, n_tokens) of its shards."""
    encoder, pack_shard, state = TextEncoder, pack, worker_state

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        enc = state(f"text_encoder:{vocabulary}", lambda: encoder(vocabulary))
        end = np.array([END_ID], enc.kind).tobytes()
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        ids, names, total, made = [], [], 0, 0

        def flush():
            nonlocal ids, names, total, made
            data = np.frombuffer(b"".join(ids), enc.kind)
            sizes = [len(x) // enc.kind.itemsize for x in ids]
            name = f"{part:06d}-{made:06d}-{attempt}.wvm"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(pack_shard(data, enc.bits, names, sizes))
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "nth": [made], "name": [name], "n_docs": [len(names)], "n_tokens": [len(data)]},
                schema=pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )
            ids, names, total, made = [], [], 0, made + 1
            return row

        def runs():
            """Rows in runs of a few million characters."""
            some, size = [], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    text = batch.column(1)[i].as_py() or ""
                    some.append((batch.column(0)[i].as_py(), text))
                    size += len(text)
                    if size >= RUN_CHARS:
                        yield some
                        some, size = [], 0
            if some:
                yield some

        gc.disable()  # nothing here forms cycles, and a collection walks all units
        try:
            for some in runs():
                for (doc, _), data in zip(some, enc.encode_all([t for _, t in some])):
                    ids.append(data + end)
                    names.append(doc)
                    total += len(data) // enc.kind.itemsize + 1
                    if total >= SHARD_TOKENS:
                        yield flush()
            if names:
                yield flush()
        finally:
            gc.enable()

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(sorted_rows.mapInArrow(run, "part int, nth int, name string, n_docs long, n_tokens long"))


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the listed shard files."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    earlier = F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(
        shards.withColumn("in", F.coalesce(inside, F.lit(0)))
        .join(parts.select("part", F.coalesce(earlier, F.lit(0)).alias("before")), "part")
        .select("name", (F.col("before") + F.col("in")).alias("base")),
        "starts",
    )  # of known size, so that it can be sent to the files instead of these being shuffled
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    listed = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(starts, "name")
    reader = Shard

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                shard = reader(batch.column(1)[i].as_py())
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths.astype(np.int64))
                begins = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()), pa.array(begins + batch.column(2)[i].as_py()),
                        pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return listed.select("name", "content", "base").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes all documents as shards in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "wavelet")
    folder = folder if "://" in folder else f"file://{folder}"
    return read_shards(spark, folder, write_shards(docs, vocabulary, folder))
