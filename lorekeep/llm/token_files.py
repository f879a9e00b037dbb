"""Token counts of documents in flat token files, which hold ids and separators but no index.

Files are little-endian 16-bit ids; every document ends with one end-of-document id. A file is cut into blocks of BLOCK ids, each read by its byte
range and searched at once for separators. A block tells its separators and the lengths between them; what crosses blocks is
stitched by prefix scans over the blocks of a file: a running count of separators gives a document's ordinal, a running
maximum of separator places gives where it began. So a document may span any number of blocks.

Writing: each task encodes its documents to a file of its own in the shared folder and returns which document is the how
many-th of which file; those rows are a written table, so files of failed tries are never read.

Very long texts are read whole. Long runs of white space, at which the library's split pattern would look back without bound, are
cut out first: all but the last character of such a run is one piece by the pattern itself, and what stands before and after
it is split as it would be in the whole text.

Defined results: null and empty texts have 0 tokens; ids after a file's last separator belong to no document and are not
counted. Repeated rows and null ids are counted as rows of their own; further columns are not read. A separator's string
inside a text is ordinary text and never its id. An empty table writes no file and gives no rows.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, text_of, written

#: Ids of a block, and blocks of a group in the prefix scan.
BLOCK = 1 << 19
GROUP = 1024
END = 50_256
#: White space (of the split pattern) from this length on is cut out of a text.
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


class Encoder:
    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines())}
        self.split = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.whole = tiktoken.Encoding("piece", pat_str="(?s).+", mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        ids, at = [], 0
        for m in _RUN.finditer(text):
            z = m.end() if m.end() == len(text) else m.end() - 1
            ids += self.split.encode_ordinary(text[at : m.start()]) + self.whole.encode_ordinary(text[m.start() : z])
            at = z
        return ids + self.split.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def _encoder(ranks: str, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def _write(batches: Iterator[pa.RecordBatch], folder: str, model) -> Iterator[pa.RecordBatch]:
    import numpy as np
    from pyarrow import fs

    enc = _encoder(*model.value)
    system, path = fs.FileSystem.from_uri(folder)
    out, name, n, size = None, f"part-{uuid.uuid4().hex}.bin", 0, 0
    try:
        for b in batches:
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            for t in b.column(1).to_pylist():
                ids = np.array([*enc.encode(t), END], dtype="<u2")
                out.write(ids.tobytes())
                size += len(ids)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{folder}/{name}"] * k, pa.string()), pa.array(range(n, n + k), pa.int64()), pa.array([size] * k, pa.int64())], names=["doc_id", "file", "ordinal", "upto"])
            n += k
    finally:
        if out is not None:
            out.close()


def write_tokens(docs: DataFrame, folder: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Writes the texts as token files; (doc_id, file, ordinal, upto: ids in the file by then at most), as a written table."""
    import public_tokenizers

    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
        model = docs.sparkSession.sparkContext.broadcast((f.read(), pattern or public_tokenizers.PATTERN))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return written(map_batches(rows, partial(_write, folder=folder, model=model), "doc_id long, file string, ordinal long, upto long"), "tokens")


def _search(batches: Iterator[pa.RecordBatch], block: int, end: int) -> Iterator[pa.RecordBatch]:
    """For rows (file, at): separators in the block of ids from `at` on, with lengths between them."""
    import numpy as np
    from pyarrow import fs

    for b in batches:
        rows = []
        for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            system, path = fs.FileSystem.from_uri(name)
            with system.open_input_file(path) as f:
                ids = np.frombuffer(f.read_at(2 * block, 2 * at), dtype="<u2")
            places = np.flatnonzero(ids == end)
            rows.append((name, at, len(places), at + int(places[0]) if len(places) else None, at + int(places[-1]) if len(places) else None, (np.diff(places) - 1).tolist()))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "at", "n", "first", "last", "inner"])


def scan(files: DataFrame, block: int = BLOCK, end: int = END) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in files (file, n_ids)."""
    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_ids") - 1, F.lit(0)), F.lit(block).cast("long"))).alias("at"))
    found = map_batches(blocks.repartition("file", "at"), partial(_search, block=block, end=end), "file string, at long, n long, first long, last long, inner array<long>")
    # The prefix scan has two levels: within groups of blocks, and over the groups' sums. Only counts and places take part;
    # the lists are joined after it. So a file of any size is shared among tasks, one row a group being what one task sees of it.
    found = written(found, "blocks").withColumn("g", F.floor(F.col("at") / F.lit(block * GROUP)))
    small = found.select("file", "g", "at", "n", "last")
    sums = small.groupBy("file", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.select("file", "g", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("g_skip"), F.max("last").over(over).alias("g_since"))
    inside = Window.partitionBy("file", "g").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.select("file", "g", "at", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("skip"), F.max("last").over(inside).alias("since")).join(groups, ["file", "g"])
    placed = placed.select("file", "at", (F.col("skip") + F.col("g_skip")).alias("skip"), F.coalesce("since", "g_since", F.lit(-1)).alias("since"))
    known = found.filter("n > 0").join(placed, ["file", "at"])
    lengths = F.concat(F.array(F.col("first") - F.col("since") - 1), F.col("inner"))
    return known.select("file", "skip", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("skip") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(spark: SparkSession, manifest: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of the documents of a manifest made by write_tokens."""
    files = manifest.groupBy("file").agg(F.max("upto").alias("n_ids"))
    # Both sides grow with the corpus, and a manifest's files are far smaller than its rows: never a broadcast.
    return manifest.hint("merge").join(scan(files, block), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(spark, write_tokens(docs, fresh_path(spark, "tokens")))
