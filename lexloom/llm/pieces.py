"""SentencePiece encoding and decoding through a distinct-chunk table (operator 8).

In the given model no piece holds a white-space marker after another character, so a segmentation never crosses the start
of a marked word. A text is cut into such chunks; each task keeps a table from chunk to the bytes of its ids, hands chunks
that are not in it to the library, all of a batch in one call, and joins the ids of a text by position. The table is bounded
by the bytes that it holds and starts anew when full, and chunks of more than LONG_CHUNK characters (text without spaces,
encoded data) never enter it; that costs time, never results. A model is refused if its pieces cross markers, or if
its normalizer changes characters or white space on the probes below, so that chunks would not add up to the text.

Defined edge cases: a null text counts as empty (begin and end ids only); texts of any length are encoded whole; repeated
rows give repeated results; equal chunks share one entry; the input's other columns do not enter; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: bytes of chunks and ids that a task's table may hold (with some 150 more for each entry), and the longest chunk in it
TABLE_BYTES, ENTRY_BYTES, LONG_CHUNK = 96 << 20, 150, 256
CHUNKS_PER_CALL = 20_000
# Texts that a normalizer or a dummy-prefix setting would show itself on.
PROBES = ("", " ", "a", " a", "a ", "a  b", "  a   b  ", "▁", "a▁b", "▁ a", "ﬁ Ａ ½", "e\u0301 é", "a\u00a0b\u3000c", "a\tb\nc\r\n", "\u200b\ufeff", "日本 語", "\x00")
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def processor(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def crossing_pieces(sp) -> list[str]:
    """Pieces with a marker after another character; the chunk table is exact only if there are none."""
    return [p for p in map(sp.id_to_piece, range(sp.vocab_size())) if re.search(f"[^{MARK}]{MARK}", p)]


class ChunkTable:
    """Encodes texts as bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, sp, limit: int = TABLE_BYTES):
        self.sp, self.limit, self.held = sp, limit, 0
        self.table: dict[str, bytes] = {}
        self.mark = np.array([sp.piece_to_id(MARK)], "<u4").tobytes()
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first marker, which the library puts back before each text it encodes."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            parts = self.chunks(text)
            joined = [self.begin]
            for at in range(0, len(parts), CHUNKS_PER_CALL):
                some = parts[at : at + CHUNKS_PER_CALL]
                try:
                    joined += map(self.table.__getitem__, some)
                except KeyError:
                    del joined[1 + at :]
                    passing = self._learn(some)
                    joined += [passing[c] if c in passing else self.table[c] for c in some]
            joined.append(self.end)
            out.append(b"".join(joined))
        return out

    def _learn(self, some: list[str]) -> dict[str, bytes]:
        """Enter the new chunks; return the long ones, which do not enter."""
        if self.held > self.limit:
            self.table.clear()
            self.held = 0
        new, long = list({c for c in some if c not in self.table}), {}
        for chunk, ids in zip(new, self.sp.encode(new, num_threads=1)):
            raw = np.array(ids, "<u4").tobytes() if chunk else self.mark
            if len(chunk) > LONG_CHUNK:
                long[chunk] = raw
            else:
                self.table[chunk] = raw
                self.held += len(chunk) + len(raw) + ENTRY_BYTES
        return long


def refused(sp) -> str | None:
    """Why the chunk table would not be exact for a model."""
    if bad := crossing_pieces(sp):
        return f"pieces cross white-space markers: {bad[:5]}"
    table = ChunkTable(sp)
    for text, raw in zip(PROBES, table.encode(list(PROBES))):
        if np.frombuffer(raw, "<u4").tolist() != sp.encode(text, add_bos=True, add_eos=True):
            return f"its normalizer changes {text!r}"
    return None


def encode_documents(df: DataFrame, proto: bytes, with_output: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_output adds ids (array) and decoded (text)."""
    if why := refused(processor(proto)):
        raise ValueError(why)
    id_type = df.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(proto)
        table = ChunkTable(sp)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids_hash, text_hash, all_ids, all_text = [], [], [], [], []
                for raw in table.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    text = sp.decode(ids)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(raw).hexdigest())
                    text_hash.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_output:
                        all_ids.append(ids)
                        all_text.append(text)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_output:
                    cols += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_text, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {id_type.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * with_output
    return df.select("doc_id", "text").mapInArrow(run, schema)
