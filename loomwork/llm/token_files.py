"""Token ids in flat binary files with 64-bit document offsets.

A folder holds numbered shards and ``manifest.json``.  Shard ``k`` is three files:

* ``shard-k.tokens``: the ids of its documents, end to end, as little-endian unsigned 16-bit integers, or
  32-bit ones if the vocabulary needs them;
* ``shard-k.offsets``: documents + 1 unsigned 64-bit integers, where each document begins in the shard;
* ``shard-k.docs``: the documents' ids as signed 64-bit integers (0 where it is null).

Shards follow one another in ascending document order.  The manifest lists, for every shard, its number
of documents, tokens and null ids and its bases: how many documents and tokens come before it, which are prefix
sums of the counts.  All files can be memory-mapped where the folder is on a mounted file system.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.batches import ids_and_texts, slices
from loomwork.plans.shipping import ship

END_ID = 0
#: Chunks whose ids a worker keeps; beyond it the memory starts afresh, which costs time only.
REMEMBERED = 3 << 19

_TWO_BLANKS = re.compile(r"\s\s")
_MARKS = frozenset(".,;:!?")


class ChunkedTokenizer(dict):
    """The tokenizers library behind a memory of chunks (key -> raw ids).

    Where no two white-space characters touch, a byte-level BPE's pre-tokens never cross a blank or a
    line feed that has a character on both sides, so texts are cut there and each distinct chunk is encoded
    once.  A chunk of letters alone is one pre-token and goes to the library's BPE model directly; a
    mark that follows it is a pre-token of its own.  All other chunks, and all other texts, go through the whole
    tokenizer.
    """

    def __init__(self, spec: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        layers = json.loads(spec)
        form = layers.get("pre_tokenizer") or {}
        self.can_cut = layers.get("normalizer") is None and form.get("type") == "ByteLevel" and form.get("use_regex", True) and not form.get("add_prefix_space")
        #: The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on.
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
        self.alphabet = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def _raw(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _letters(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.model.tokenize(spelled)], self.dtype).tobytes()

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if key.isalpha():
            raw = self._letters(" " + key)
        elif key[-1:] in _MARKS and key[:-1].isalpha():
            raw = self[key[:-1]] + self._raw(key[-1])
        else:
            raw = self._raw(key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key)
        self[key] = raw
        return raw

    def cut(self, text: str) -> list[str] | None:
        """Keys of the chunks: after a blank, or with their line feed, or (the first) after NUL."""
        if not self.can_cut or _TWO_BLANKS.search(text) or "\0" in text or any(a in text for a in self.added):
            return None
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as raw integers of ``dtype``."""
        cuts = map(self.cut, texts)
        return [b"".join(map(self.__getitem__, parts)) if parts is not None else self._raw(text) for text, parts in zip(texts, cuts, strict=True)]


@lru_cache(maxsize=2)
def _tokenizer(spec: str) -> ChunkedTokenizer:
    return ChunkedTokenizer(spec)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme: one without is on the default file system, as for all of Spark's own paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> dict:
    """Encode every whole text, write the files into ``folder`` (new or empty) and return the manifest.

    Documents are dealt by ranges of their id, null ids first and equal ids in the order of their
    texts' hashes, and sorted inside each range.  Null texts are empty; every document ends with
    ``end_id``; repeated rows are documents of their own; an empty table gives a manifest without shards.
    A task writes under a name of its own and renames at the end, so retried and speculative tasks are harmless.
    Only the counts of the shards come to the driver.
    """
    spark = docs.sparkSession
    spec = Path(tokenizer_path or default_tokenizer()).read_text()
    dtype, folder = _tokenizer(spec).dtype.str, qualified(spark, folder)
    files, base = _place(folder)
    files.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        store, at = _place(folder)
        names = [f"{at}/shard-{shard:05d}.{kind}" for kind in ("tokens", "offsets", "docs")]
        drafts = [f"{n}.{attempt}.part" for n in names]
        coder, end = _tokenizer(spec), np.array([end_id], dtype).tobytes()
        width, sizes, ids, nulls = np.dtype(dtype).itemsize, [], [], 0
        out = None
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for _, part in slices(texts):
                out = out or store.open_output_stream(drafts[0])
                raw = coder.encode(part.to_pylist())
                sizes.append(np.array([len(r) // width + 1 for r in raw], np.uint64))
                out.write(end.join(raw) + end)
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            nulls += batch.column(0).null_count
        if out is None:
            return
        out.close()
        lengths = np.concatenate(sizes)
        offsets = np.zeros(len(lengths) + 1, "<u8")
        np.cumsum(lengths, out=offsets[1:])
        for name, data in ((drafts[1], offsets), (drafts[2], np.concatenate(ids).astype("<i8"))):
            with store.open_output_stream(name) as stream:
                stream.write(data.tobytes())
        for draft, name in zip(drafts, names, strict=True):
            store.move(draft, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(lengths)], "tokens": [int(offsets[-1])], "nulls": [nulls]})

    ship(spark)
    tie = F.xxhash64("text")
    sorted_docs = ids_and_texts(docs, id_col, text_col).withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    counts = sorted_docs.mapInArrow(write, "shard long, docs long, tokens long, nulls long").collect()
    shards, doc_base, token_base = [], 0, 0
    for c in sorted(counts):
        shards.append({"shard": c.shard, "docs": c.docs, "tokens": c.tokens, "nulls": c.nulls, "doc_base": doc_base, "token_base": token_base})
        doc_base, token_base = doc_base + c.docs, token_base + c.tokens
    manifest = {"dtype": dtype, "end_id": end_id, "docs": doc_base, "tokens": token_base, "shards": shards}
    with files.open_output_stream(f"{base}/manifest.json") as stream:
        stream.write(json.dumps(manifest).encode())
    return manifest


def _mapped(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with store.open_input_file(path) as stream:
        return np.frombuffer(stream.read_buffer(), dtype)


def _each_shard(spark: SparkSession, folder: str, columns: dict, schema: str) -> DataFrame:
    """One task for each shard; ``columns``: name -> function of (a run of documents' ids arrays)."""
    folder = qualified(spark, folder)
    files, base = _place(folder)
    with files.open_input_file(f"{base}/manifest.json") as stream:
        manifest = json.loads(stream.read())
    shards, dtype = manifest["shards"], manifest["dtype"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _place(folder)
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            shard = shards[k]
            tokens, offsets, ids = (_mapped(store, f"{at}/shard-{shard['shard']:05d}.{kind}", kind_type) for kind, kind_type in (("tokens", dtype), ("offsets", "<u8"), ("docs", "<i8")))
            for first in range(0, len(ids), 2048):
                last = min(first + 2048, len(ids))
                edges = offsets[first : last + 1].astype(np.int64)
                parts = [tokens[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                made = {"doc_id": pa.array(ids[first:last].astype(np.int64), mask=np.arange(first, last) < shard["nulls"]), "start": pa.array(edges[:-1] + shard["token_base"]), "n_tokens": pa.array(np.diff(edges))}
                yield pa.RecordBatch.from_pydict(made | {name: make(parts) for name, make in columns.items()})

    ship(spark)
    n = len(shards)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(read, f"doc_id long, start long, n_tokens long{schema}")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids array<long>)`` of every document of the files, end id included."""

    def ids(parts: list[np.ndarray]) -> pa.Array:
        return pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))

    return _each_shard(spark, folder, {"ids": ids}, ", ids array<long>")


def read_token_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``: the checksum is of the ids as 32-bit little-endian integers."""

    def crc(parts: list[np.ndarray]) -> pa.Array:
        return pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())

    return _each_shard(spark, folder, {"ids_crc32": crc}, ", ids_crc32 long")
