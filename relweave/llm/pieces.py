"""SentencePiece encoding by a score-ordered agenda of adjacent symbol pairs.

For merge-type vocabularies. A text is cut where no piece can span: before each
run of spaces, and between two characters that no piece holds side by side. Within
a cut piece the symbols start as characters; an agenda of neighbouring pairs that
form a piece is worked off best score first, leftmost on ties. Characters the
vocabulary lacks become byte pieces. What a worker has learnt for one unit is
kept, and per Arrow batch every newly learnt unit is checked against the
sentencepiece library, which also decodes. A difference stops the job.

Edge cases: a NULL text is an empty one and gives the begin and end ids only;
leading, trailing and repeated spaces are kept as the model has them; very long
words cost n log n; repeated rows each give a row; other columns are carried by
``encoded`` unchanged.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import wider, worker_state

#: Units a worker keeps at most; beyond that it learns them anew.
KEEP_UNITS = 400_000
#: Characters up to which scanning a list beats a heap.
SHORT = 48
#: Where a cut is looked for: around everything but letters.
_RUNS = re.compile(r"▁*[^\W\d_]+|.", re.S)


class Codec:
    """Encoder of one model file; ``encode`` gives ids as little-endian 32-bit integers."""

    def __init__(self, model: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [
            i for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        ]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        scores = sorted({sp.get_score(i) for i in order}, reverse=True)
        place = {s: n for n, s in enumerate(scores)}
        self.rank = {p: place[sp.get_score(i)] for p, i in self.ids.items() if len(p) > 1}
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in self.byte_ids):
            self.byte_ids = None
        self.unknown = sp.unk_id()
        self.begin, self.end = struct.pack("<I", sp.bos_id()), struct.pack("<I", sp.eos_id())
        # a unit starts with a space; that is a cut if spaces only open pieces
        self.cut_at_space = not any("▁" in p.lstrip("▁") for p in self.rank)
        self.units: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.fresh: list[str] = []

    def merged(self, text: str) -> list[str]:
        """Pieces of one part by the agenda.

        A short part's agenda is a plain list, one entry per neighbouring pair,
        whose least entry is looked up; a long part's is a heap.
        """
        rank = self.rank
        n = len(text)
        if n == 1:
            return [text]
        symbols = list(text)
        if n <= SHORT:
            get, none = rank.get, 1 << 60
            agenda = [get(text[i : i + 2], none) for i in range(n - 1)]
            while agenda and (best := min(agenda)) != none:
                i = agenda.index(best)
                symbols[i] = joined = symbols[i] + symbols[i + 1]
                del symbols[i + 1], agenda[i]
                if i < len(agenda):
                    agenda[i] = get(joined + symbols[i + 1], none)
                if i:
                    agenda[i - 1] = get(symbols[i - 1] + joined, none)
            return symbols
        agenda = []
        for i in range(n - 1):
            r = rank.get(text[i : i + 2])
            if r is not None:
                agenda.append((r, i, 2))
        if not agenda:
            return symbols
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, size = pop(agenda)
            left = symbols[i]
            if not left:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != size:
                continue  # one of the two has been merged meanwhile
            left = symbols[i] = left + symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = left + symbols[k]
                r = rank.get(pair)
                if r is not None:
                    push(agenda, (r, i, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + left
                r = rank.get(pair)
                if r is not None:
                    push(agenda, (r, h, len(pair)))
        return [s for s in symbols if s]

    def part(self, text: str) -> bytes:
        out = []
        for piece in self.merged(text):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def unit(self, word: str) -> bytes:
        """Ids of ``word`` behind one space."""
        pairs, parts = self.pairs, self.parts
        out, held = [], ""
        for run in _RUNS.findall("▁" + word.replace(" ", "▁")):
            if held and held[-1] + run[0] not in pairs:
                out.append(held)
                held = run
            else:
                held += run
        out.append(held)
        for i, t in enumerate(out):
            ids = parts.get(t)
            if ids is None:
                ids = self.part(t)
                if len(parts) < KEEP_UNITS:
                    parts[t] = ids
            out[i] = ids
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text with begin and end ids."""
        if not text:
            return self.begin + self.end
        line = " " + text.replace("▁", " ")
        if not self.cut_at_space:
            words = [line[1:]]
        elif "  " in line or line[-1] == " ":
            words = [m[1:] for m in re.findall(" +[^ ]*", line)]
        else:
            words = line.split(" ")
            del words[0]
        units = self.units
        try:
            ids = b"".join([units[w] for w in words])
        except KeyError:
            found = []
            full = len(units) >= KEEP_UNITS
            for w in words:
                u = units.get(w)
                if u is None:
                    u = self.unit(w)
                    self.fresh.append(w)
                    if not full:
                        units[w] = u
                found.append(u)
            ids = b"".join(found)
        return self.begin + ids + self.end

    def verify(self) -> None:
        """Hold what was learnt since the last call against the library."""
        if not self.fresh:
            return
        words, self.fresh = [w for w in dict.fromkeys(self.fresh) if w], []  # '' alone the library trims
        for w, want in zip(words, self.library.encode(words, num_threads=1)):
            got = self.units.get(w) or self.unit(w)
            if got != struct.pack(f"<{len(want)}I", *want):
                raise ValueError(f"agenda and library differ on {w!r}")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with p_ids (binary, little-endian 32-bit) and p_decoded, which replace older ones."""
    make, state = Codec, worker_state

    def run(batches):
        import pyarrow as pa

        codec = state(f"piece_codec:{model}", lambda: make(model))
        unpack = struct.unpack
        gc.disable()  # nothing here forms cycles, and a collection walks all units
        try:
            for batch in batches:
                ids, decoded = [], []
                for t in batch.column("__text"):
                    data = codec.encode(t.as_py() or "")
                    ids.append(data)
                    decoded.append(codec.library.decode(list(unpack(f"<{len(data) // 4}I", data))))
                codec.verify()
                names = [f for f in batch.schema.names if f != "__text"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f) for f in names], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=[*names, "p_ids", "p_decoded"],
                )
        finally:
            gc.enable()

    docs = docs.drop("p_ids", "p_decoded")
    schema = wider(docs, p_ids="binary", p_decoded="string")
    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str, ids: str = "p_ids") -> DataFrame:
    """``rows`` with p_text, the text of their ids."""
    state = worker_state

    def run(batches):
        import pyarrow as pa
        import sentencepiece

        sp = state(f"piece_library:{model}", lambda: sentencepiece.SentencePieceProcessor(model_file=model))
        for batch in batches:
            raw = [x.as_py() or b"" for x in batch.column(ids)]
            texts = [sp.decode(list(struct.unpack(f"<{len(x) // 4}I", x))) for x in raw]
            yield batch.append_column("p_text", pa.array(texts, pa.string()))

    rows = rows.drop("p_text")
    return rows.mapInArrow(run, wider(rows, p_text="string"))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    out = encoded(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", (F.length("p_ids") / 4).cast("long").alias("n_tokens"), F.sha2("p_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("p_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
