"""Token-id output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

A folder holds, for each part k in ascending id order:

- part-k.bin: the ids, little-endian, uint16 where the vocabulary and the end id fit, else uint32;
- part-k.idx: little-endian 64-bit numbers: documents n, 1 if ids are uint16 else 2 (then uint32), n
  document ids, n flags (0: the id is null), n + 1 offsets (in ids, from the part's start).

manifest.json lists the parts with the ids and documents before each: prefix sums of the parts'
counts. A part is written under an attempt's own name and then renamed, so a task that runs again
leaves the same file. Defined cases: null text is empty (its end id only); null ids come first;
repeated ids are ordered by a hash of the text; extra columns play no part; an empty table gives a
manifest without parts.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, scratch_path
from .tokens import encoder

END_ID = 2


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> str:
    """Write docs (doc_id, text) to the folder, which all machines must share; returns the folder.

    The range partitions of (doc_id, text hash) are the parts, so repeated ids can be split too.
    """
    target = Path(local_path(folder))
    target.mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(tokenizer_path), TaskContext.get()
        part, kind = task.partitionId(), np.uint16 if max(coder.whole.get_vocab_size() - 1, end_id) < 1 << 16 else np.uint32
        end = end_id.to_bytes(4, "little")
        target.mkdir(parents=True, exist_ok=True)
        draft = target / f"part-{part:06d}.attempt-{task.taskAttemptId()}"
        ids, lengths, total = [], [], 0
        with open(draft, "wb") as file:
            for batch in batches:
                ids += batch.column(0).to_pylist()
                for text in batch.column(1):
                    coded = np.frombuffer(coder.ids(text.as_py() or "") + end, "<u4")
                    file.write(coded.astype(np.dtype(kind).newbyteorder("<")).tobytes())
                    lengths.append(len(coded))
        if not ids:
            draft.unlink()
            return
        total = sum(lengths)
        index = [len(ids), np.dtype(kind).itemsize // 2, *(i or 0 for i in ids), *(int(i is not None) for i in ids), 0, *np.cumsum(lengths).tolist()]
        os.replace(draft, target / f"part-{part:06d}.bin")
        np.array(index, "<i8").tofile(draft)
        os.replace(draft, target / f"part-{part:06d}.idx")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, len(ids), total)], ["part", "docs", "tokens"])

    order = ["doc_id", "_tie"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    parts, before_docs, before = [], 0, 0
    for r in sorted(rows.select("doc_id", "text").mapInArrow(run, "part long, docs long, tokens long").collect()):
        parts.append({"part": r["part"], "docs": r["docs"], "tokens": r["tokens"], "docs_before": before_docs, "tokens_before": before})
        before_docs, before = before_docs + r["docs"], before + r["tokens"]
    draft = target / "manifest.json.draft"
    draft.write_text(json.dumps({"format": 1, "end_id": end_id, "docs": before_docs, "tokens": before, "parts": parts}))
    os.replace(draft, target / "manifest.json")
    return folder


class TokenPart:
    """One part, memory-mapped: only the pages that are read are loaded."""

    def __init__(self, folder: str, part: int) -> None:
        name = f"{local_path(folder)}/part-{part:06d}"
        index = np.memmap(f"{name}.idx", "<i8", "r")
        n, width = int(index[0]), int(index[1])
        self.doc_ids, self.valid, self.offsets = index[2 : 2 + n], index[2 + n : 2 + 2 * n], index[2 + 2 * n :]
        self.ids = np.memmap(f"{name}.bin", "<u2" if width == 1 else "<u4", "r")
        if len(self.offsets) != n + 1 or len(self.ids) != self.offsets[-1]:
            raise ValueError(f"{name}: files of different lengths")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (and ids) of every document."""
    manifest = json.loads(Path(local_path(folder), "manifest.json").read_text())
    parts = [(p["part"], p["tokens_before"]) for p in manifest["parts"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = TokenPart(folder, k)
                for at in range(0, len(part), 2000):
                    to = min(len(part), at + 2000)
                    docs = [part[i].astype("<u4") for i in range(at, to)]
                    columns = [
                        pa.array(np.asarray(part.doc_ids[at:to]), mask=np.asarray(part.valid[at:to]) == 0), pa.array(part.offsets[at:to] + before),
                        pa.array(np.diff(part.offsets[at : to + 1])), pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([d.tobytes() for d in docs], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    table = spark.createDataFrame(parts, "part long, tokens_before long")
    table = table.repartition(max(1, len(parts)), "part") if parts else table
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files (to a scratch folder unless one is named) and read them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, folder or scratch_path(spark, "tokens"), tokenizer_path, end_id))
