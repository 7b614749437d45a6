"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Spark deals out whole documents; there is no shuffle. In a partition each batch of texts is cut into
pieces by the tokenizer's pattern, and the pieces not met before go to an in-memory DuckDB: one row
a token position, joined with the vocabulary on the concatenation of neighbours; every step contracts
each piece's leftmost pair of least rank, until no pair is in the vocabulary. Decoding
is a DuckDB query too: ids joined with the vocabulary and aggregated in order.

Memory: the vocabulary, one batch, and about twice ``PIECES`` pieces per task, and twice ``CHUNKS`` chunks per worker, which last; a full cache becomes
the old generation, which costs time but never changes results. The recursion keeps only the last step of each piece; DuckDB is held to
``LIMIT`` and never spills. Time for one unbroken piece grows with the square of its tokens. Defined results: null text counts as
empty and has no ids; repeated rows are encoded one by one; a piece of any length is encoded whole; ids may be of any type; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PIECES, CHUNKS = 150_000, 150_000
#: Texts are taken up so many rows at a time and handled in groups of about so many code points; pieces go to DuckDB in parts of so many bytes.
GROUP, ROWS, BYTES = 1_000_000, 500, 2_000_000


LIMIT = "500MB"

#: White space next to a space.
BESIDE = re.compile(r"\s | \s").search


class Chunks(dict):
    """Ids of chunks, in two generations; a chunk in neither is noted in ``new`` and has None so far."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.old.get(chunk)
        if ids is None:
            self.new.append(chunk)
        self[chunk] = ids
        return ids

    def begin(self) -> None:
        self.new = []
        if len(self) > CHUNKS:
            self.old = dict(self)
            self.clear()


_kept: dict[tuple[str, str], Chunks] = {}


def kept_chunks(path: str, pattern: str) -> Chunks:
    """Chunks that earlier tasks of this worker have encoded by the same vocabulary; those of another one go."""
    if (path, pattern) not in _kept:
        _kept.clear()
    chunks = _kept.setdefault((path, pattern), Chunks())
    for c in chunks.new:  # noted by a task that failed before it had their ids
        if dict.get(chunks, c) is None:
            chunks.pop(c, None)
    return chunks


class Ranks:
    """A vocabulary in an in-memory DuckDB. Token bytes are held as strings of the code points 0 to 255."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.cut = regex.compile(pattern).findall
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": LIMIT, "temp_directory": ""})
        vocabulary = pa.table({"tok": [k.decode("latin-1") for k in ranks], "id": pa.array(ranks.values(), pa.int32())})
        self.db.register("v", vocabulary)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.db.unregister("v")
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunks = kept_chunks(path, pattern)

    def encode_pieces(self, pieces: set[str]) -> None:
        """Encode pieces by the recursive query and keep them."""
        if len(self.pieces) > PIECES:
            self.old, self.pieces = self.pieces, {}
        new, held, size = [], [], 0
        for x in pieces.difference(self.pieces):
            if x in self.old:
                self.pieces[x] = self.old[x]
                continue
            new.append(x)
            size += len(x)
            if size > BYTES or len(new) == 50_000:
                held.append(new)
                new, size = [], 0
        for some in [*held, new] if new else held:
            self.db.register("pieces", pa.table({"w": pa.array(range(len(some)), pa.int32()), "s": [x.encode().decode("latin-1") for x in some]}))
            rows = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("pieces")
            for w, ids in zip(rows["w"].to_pylist(), rows["ids"].to_pylist(), strict=True):
                self.pieces[some[w]] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        No piece holds a space after its first character, so a text without spaces beside other white
        space is cut at its spaces first, and each distinct chunk (a space and what follows) is cut by the pattern once.
        """
        self.chunks.begin()
        found: list[tuple[list[str], list[str], list[bytes | None]]] = []
        for t in texts:
            head, rest = (self.cut(t), []) if BESIDE(t) else (self.cut((parts := t.split(" "))[0]), parts[1:])
            found.append((head, rest, list(map(self.chunks.__getitem__, rest))))
        cut = {c: self.cut(f" {c}") for c in self.chunks.new}
        self.encode_pieces(set().union(*cut.values(), *(head for head, _, _ in found)))
        get = self.pieces.__getitem__
        for c, pieces in cut.items():
            self.chunks[c] = b"".join(map(get, pieces))
        out = []
        for head, rest, ids in found:
            if None in ids:
                ids = [self.chunks[c] if x is None else x for c, x in zip(rest, ids, strict=True)]
            out.append(b"".join([*map(get, head), *ids]))
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids, by ordered aggregation of the vocabulary's entries."""
        import numpy as np

        counts = [len(x) // 4 for x in ids]
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        self.db.register("stream", pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int64), "id": flat}))
        rows = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("stream")
        out = [b""] * len(ids)
        for d, s in zip(rows["doc"].to_pylist(), rows["s"].to_pylist(), strict=True):
            out[d] = s.encode("latin-1")
        return out


#: A piece that is itself in the vocabulary is one token. ``step`` holds each piece's tokens, keyed by the piece, so that a contraction replaces
#: the row before; positions become rows, which join the vocabulary on what they and their right neighbours make together.
ENCODE = """
WITH RECURSIVE whole AS MATERIALIZED (
  SELECT w, s, id FROM pieces LEFT JOIN vocab ON tok = s
), step(w, toks) USING KEY (w) AS (
  SELECT w, string_split(s, '') FROM whole WHERE id IS NULL
  UNION ALL
  SELECT w, toks[1:k - 1] || [toks[k] || toks[k + 1]] || toks[k + 2:]
  FROM step JOIN (
    SELECT w, min(id::BIGINT << 31 | pos) & 2147483647 AS k
    FROM (SELECT w, unnest(range(1, len(toks))) AS pos, unnest(list_zip(toks, toks[2:])) AS t FROM step)
    JOIN vocab ON tok = t[1] || t[2]
    GROUP BY w
  ) USING (w)
)
SELECT w, [id] AS ids FROM whole WHERE id IS NOT NULL
UNION ALL
SELECT w, list(id ORDER BY pos) AS ids
FROM (SELECT w, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM step) JOIN vocab USING (tok) GROUP BY w
"""

DECODE = """
SELECT doc, string_agg(tok, '') AS s
FROM (SELECT doc, tok FROM stream JOIN vocab USING (id) ORDER BY pos) GROUP BY doc
"""


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about GROUP code points."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= GROUP:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tokenized(
    docs: DataFrame, locate: Callable[[], tuple[str, str]], key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256; with_ids: the ids and the decoded text as well.

    ``locate`` gives the vocabulary's path and pattern on the executor that asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = Ranks(*locate())  # one a task: a worker that goes on to other work keeps the chunks alone
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts):
                ids = bpe.encode(texts[a:b])
                back = bpe.decode(ids)
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                ]
                if with_ids:
                    columns += [
                        pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())),
                        pa.array([x.decode() for x in back], pa.string()),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.db.close()

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(run, schema + (", ids array<long>, decoded string" if with_ids else ""))


def public_bpe() -> tuple[str, str]:
    """The public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
